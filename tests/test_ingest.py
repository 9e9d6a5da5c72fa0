"""Files that are loaded as a whole or not at all."""

from __future__ import annotations

import pytest

from tillspark import cli
from tillspark.operators.joins import last_wins
from tillspark.sources.ingest import ingest


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode())


def test_one_bad_line_of_three_files(spark, tmp_path):
    write(tmp_path / "s", store_1="h\n1,North,x\n2,South,x,extra\n", store_2="h\n3,East,x\nshort,line\n4,West,x\n5\n", store_3="h\r\n6,Up\x01here,x\r\n", notes="h\nnothing\n")
    x = ingest(spark, str(tmp_path / "s"), "store", "store")
    assert sorted(map(tuple, x.good.drop("_order").collect())) == [("1", "North"), ("2", "South"), ("6", "Up\x01here")]
    rejects = x.rejects.collect()
    assert [(r.file.rsplit("/", 1)[-1], r.n_lines, r.n_bad, r.line, r.reason) for r in rejects] == [("store_2.csv", 4, 2, "short,line", "store: under 3 fields: 2")]
    assert sorted((r.file.rsplit("/", 1)[-1], r.n_lines, r.n_bad) for r in x.files.collect()) == [("store_1.csv", 2, 0), ("store_2.csv", 4, 2), ("store_3.csv", 1, 0)]


def test_empty_lines_headers_and_files(spark, tmp_path):
    """An empty line is a bad one; a short header is none; files without rows are good."""
    write(tmp_path / "m", menu_a="h\n1,Tea\n\n2,Milk\n", menu_b="", menu_c="only a header\n", menu_d="\n3,Juice\n", menu_e="h\n1,Cocoa\n1,Coffee")
    x = ingest(spark, str(tmp_path / "m"), "menu", "menu")
    assert sorted(map(tuple, x.good.drop("_order").collect())) == [("1", "Cocoa"), ("1", "Coffee"), ("3", "Juice")]
    assert [(r.n_lines, r.n_bad, r.line) for r in x.rejects.collect()] == [(3, 1, "")]
    assert sorted(map(tuple, last_wins(x.good, "item_id", "item_name").collect())) == [("1", "Coffee"), ("3", "Juice")]
    with pytest.raises(FileNotFoundError):
        ingest(spark, str(tmp_path / "m"), "users", "users")


def test_large_files_in_several_parts(spark, tmp_path):
    """A file that is read in parts is still one; its header is the first line of its first part."""
    good = "h\n" + "".join(f"{k},name {k}\n" for k in range(30_000))
    write(tmp_path / "m", menu_1=good, menu_2=good + "bad\n" + "1,x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        x = ingest(spark, str(tmp_path / "m"), "menu", "menu")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert x.good.count() == 30_000 and x.good.where("item_id = 'h'").isEmpty()
    assert [(r.n_lines, r.n_bad, r.line) for r in x.rejects.collect()] == [(30_002, 1, "bad")]


def test_command_line_rejects_files(spark, tmp_path):
    write(tmp_path / "transactions", transactions_1="h\nt1,1,1,,7.0,100,0,100,2024-03-01 07:00:00\n", transactions_2="h\nt2,1,1,,8,100,0,100,2024-03-01 07:00:00\nbad\n")
    write(tmp_path / "store", store_1="h\n1,North,street\n")
    write(tmp_path / "users", users_1="h\n7,f,1990-01-02\n7,f,1990-01-03\n")
    out = str(tmp_path / "out")
    cli.main([str(tmp_path), out, "--tables", "transactions,store,users", "--bad-rows", "file"])
    assert [r.value for r in spark.read.text(f"{out}/results_q1").collect()] == ["t1,1,7,100.000000,2024-03-01 07:00:00"]
    assert [r.value for r in spark.read.text(f"{out}/results_q3").collect()] == ["2024-H1,1,100.000000"]
    assert [r.value for r in spark.read.text(f"{out}/results_q4").collect()] == ["North,1990-01-03"]
    assert [r.line for r in spark.read.json(f"{out}/rejects_transactions").collect()] == ["bad"]

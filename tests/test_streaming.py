"""Streams: partial tables that survive a repeated batch, clients that end, text that arrives in drops."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

from tillspark.config import Params
from tillspark.operators.aggregates import semester_stores
from tillspark.operators.cleaners import clean
from tillspark.operators.joins import last_wins
from tillspark.plans import catalog
from tillspark.shared import fresh_path
from tillspark.sources.files import scan_lines
from tillspark.sources.schemas import CLEANED
from tillspark.streaming import jobs
from tillspark.streaming.ends import end_marks, groups_at_end
from tillspark.streaming.partials import BATCH, compact, read_partials, write_partials
from tillspark.streaming.state import state_session
from tillspark.streaming.text import land, landed


def at(month: int) -> datetime:
    return datetime(2024, month, 3, 7)


ROWS = [
    [("t1", "a", "u", 0.1, at(1)), ("t2", "b", "u", 5.0, at(9))],
    [("t3", "a", "v", 0.2, at(2)), ("t4", "a", None, 1.0, at(8))],
    [("t5", "a", "v", 0.3, at(3)), ("t6", "b", "v", 0.7, at(12))],
]


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, CLEANED["transactions"]).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return state_session(spark).readStream.schema(CLEANED["transactions"]).option("maxFilesPerTrigger", 1).parquet(folder)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_a_killed_and_repeated_batch_gives_the_same_totals(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in ROWS:
        arrive(spark, folder, rows)
    keys = ["semester", "store_id"]
    seen = []

    def killed(number):
        seen.append(number)
        if number == 1 and seen.count(1) < 3:
            raise RuntimeError("killed after its rows were written")

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            write_partials(semester_stores(stream(spark, folder)), out, checkpoint, killed)
    write_partials(semester_stores(stream(spark, folder)), out, checkpoint, killed)
    assert seen == [0, 1, 1, 1, 2]
    every = spark.createDataFrame([r for rows in ROWS for r in rows], CLEANED["transactions"])
    assert found(jobs.semester_totals(spark, out)) == found(semester_stores(every)) == [("2024-H1", "a", 0.6), ("2024-H2", "a", 1.0), ("2024-H2", "b", 5.7)]
    # as of an earlier batch, and each batch's own changes once
    assert len(found(read_partials(spark, out, jobs.SEMESTERS, keys, up_to=0))) == 2
    assert spark.read.parquet(out).where(f"{BATCH} = 1").count() == 2
    # later arrivals go on from there, and nothing new changes nothing
    arrive(spark, folder, [("t7", "c", "u", 1.5, at(1))])
    for _ in range(2):
        write_partials(semester_stores(stream(spark, folder)), out, checkpoint)
        assert ("2024-H1", "c", 1.5) in found(jobs.semester_totals(spark, out))
    assert len(found(jobs.semester_totals(spark, out))) == 4


def test_compacted_partials(spark, tmp_path):
    """Reads from a base and the batches behind it; files of the batches that it holds aren't opened."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    keys, base = ["semester", "store_id"], None
    compact(spark, out, jobs.SEMESTERS, keys, str(tmp_path / "base-none"))
    assert found(read_partials(spark, out, jobs.SEMESTERS, keys, base=str(tmp_path / "base-none"))) == []
    for k, rows in enumerate(ROWS):
        arrive(spark, folder, rows)
        write_partials(semester_stores(stream(spark, folder)), out, checkpoint)
        whole = found(read_partials(spark, out, jobs.SEMESTERS, keys))
        assert found(read_partials(spark, out, jobs.SEMESTERS, keys, base=base)) == whole
        compact(spark, out, jobs.SEMESTERS, keys, str(tmp_path / f"base-{k}"), base)
        base = str(tmp_path / f"base-{k}")
        assert found(read_partials(spark, out, jobs.SEMESTERS, keys, base=base)) == whole
        if k == 1:
            for file in (tmp_path / "out").glob("_batch=*/*.parquet"):
                file.write_bytes(b"not a table")
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            assert found(read_partials(spark, out, jobs.SEMESTERS, keys, base=base)) == whole
            break
    arrive(spark, folder, ROWS[2])
    write_partials(semester_stores(stream(spark, folder)), out, checkpoint)
    every = spark.createDataFrame([r for rows in ROWS for r in rows], CLEANED["transactions"])
    assert found(read_partials(spark, out, jobs.SEMESTERS, keys, base=base)) == found(semester_stores(every))


def test_partials_before_anything_was_written(spark, tmp_path):
    assert found(jobs.semester_totals(spark, str(tmp_path / "none"))) == []
    assert jobs.semester_totals(spark, str(tmp_path / "none")).columns == ["semester", "store_id", "tpv"]


def test_a_filter_on_the_keys_reaches_the_files(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, folder, ROWS[0])
    write_partials(semester_stores(stream(spark, folder)), out, str(tmp_path / "checkpoint"))
    plan = jobs.semester_totals(spark, out).where("store_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(store_id,a)" in plan


def test_two_clients_that_are_interleaved(spark, tmp_path):
    """One ends, is forgotten and comes back; the other hasn't ended; a third has no rows."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "client_id string, semester string, store_id string, tpv decimal(38,10), is_end boolean"

    def run(*rows):
        spark.createDataFrame([(c, s, t, None if x is None else Decimal(x), False) for c, s, t, x in rows if s != "end"], schema).coalesce(1).unionByName(
            end_marks(spark.createDataFrame([(c,) for c, s, *_ in rows if s == "end"], "client_id string"), spark.createDataFrame([], schema))
        ).write.mode("append").parquet(folder)
        rows = state_session(spark).readStream.schema(schema).parquet(folder)
        jobs.appended(groups_at_end(rows, ["semester", "store_id"], ["tpv"]), out, checkpoint)
        return [] if not list((tmp_path / "out").glob("*.parquet")) else [(c, s, t, float(x)) for c, s, t, x in found(spark.read.parquet(out))]

    assert run(("a", "2024-H1", "1", "0.1"), ("b", "2024-H1", "1", "7"), ("a", "2024-H1", "2", "1"), ("a", "2024-H2", None, None)) == []
    first = [("a", "2024-H1", "1", 0.3), ("a", "2024-H1", "2", 1.0)]
    assert run(("b", "2024-H1", "1", "1"), ("a", "2024-H1", "1", "0.2"), ("a", "end", None, None), ("c", "end", None, None)) == first
    assert run(("a", "2024-H2", "1", "4"), ("b", "2024-H1", "3", "2")) == first
    assert run(("a", "end", None, None)) == [*first, ("a", "2024-H2", "1", 4.0)]
    assert run(("b", "end", None, None)) == [*first, ("a", "2024-H2", "1", 4.0), ("b", "2024-H1", "1", 8.0), ("b", "2024-H1", "3", 2.0)]


def test_three_drops_of_text_equal_the_batch_answer(spark, tmp_path):
    folder, out, checkpoint = (tmp_path / n for n in ("in", "out", "checkpoint"))
    folder.mkdir()
    drops = {"users_1.csv": "user_id,g,b,r\n1,f,1990-01-01,x\n2,m,1991-01-01,x\n", "users_2.csv": "h\n2,m,1992-02-02,x\n2,m,1993-03-03,x\n\n", "users_3.csv": "h\n3,f,1994-04-04,x\n1,f,1995-05-05,x\n", "other.csv": "h\n9,f,1,x\n"}
    for name, text in drops.items():
        (folder / name).write_text(text)
        land(spark, str(folder), "users", "users", str(out), str(checkpoint))
    answer = found(last_wins(landed(spark, str(out), "users"), "user_id", "birthdate"))
    whole = last_wins(clean(scan_lines(spark, str(folder), "users", order=True), "users"), "user_id", "birthdate")
    assert answer == found(whole) == [("1", "1995-05-05"), ("2", "1993-03-03"), ("3", "1994-04-04")]
    # a bad line stops the stream before its batch is written; mended by dropping it
    (folder / "users_4.csv").write_text("h\n4,f,1996-06-06,x\n5\n")
    with pytest.raises(Exception, match="under 3 fields"):
        land(spark, str(folder), "users", "users", str(out), str(checkpoint))
    assert landed(spark, str(out), "users").count() == 6
    land(spark, str(folder), "users", "users", str(out), str(checkpoint), bad_rows="drop")
    assert landed(spark, str(out), "users").count() == 7
    assert landed(spark, str(tmp_path / "none"), "menu").columns == ["item_id", "item_name", "_order"]


def test_streamed_questions_over_arrivals(spark, tmp_path):
    """Best buyers by arrivals, with the side tables as they are when the answer is read."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    stores = spark.createDataFrame([("a", "North"), ("b", "South")], "store_id string, store_name string")
    users = spark.createDataFrame([("v", "1990-01-02")], "user_id string, birthdate string")
    for rows in ROWS:
        arrive(spark, folder, rows)
        jobs.stream_store_users(stream(spark, folder), Params(k=1), out, checkpoint)
    assert found(jobs.buyers_birthdays(spark, out, stores, users, Params(k=1))) == [("North", "1990-01-02", 1), ("South", "u", 1)]


@pytest.mark.parametrize(("name", "arrivals"), [("stream_partials_of_drops", 3), ("stream_client_totals", 4)])
def test_a_drop_of_many_files_is_one_batch(spark, sf, monkeypatch, name, arrivals):
    """Batches are as many as arrivals, and not as the files that these have."""
    paths = {}

    def noted(session, kind):
        paths[kind] = fresh_path(session, kind)
        return paths[kind]

    monkeypatch.setattr(catalog, "fresh_path", noted)
    many = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = catalog.queries()[name](spark, sf).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    commits = Path(paths["stream-checkpoint"].removeprefix("file:")) / "commits"
    assert got > 0 and sorted(p.name for p in commits.iterdir() if not p.name.startswith(".")) == [str(k) for k in range(arrivals)]

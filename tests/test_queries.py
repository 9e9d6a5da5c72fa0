from __future__ import annotations

import duckdb
import pytest

from tillspark.plans import catalog
from tillspark.sources.files import scan_lines, selected_tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def rows(frame):
    """Names and rows in order; whole numbers beside nulls come as doubles from pandas."""
    names = sorted(frame.columns)
    values = frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None)
    return names, sorted(str(tuple(int(x) if isinstance(x, float) and x == int(x) else x for x in r)) for r in values)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n.startswith(("q", "stream", "clean", "join", "merge", "group_small", "timestamps", "best_seller", "top_profit", "dump", "split", "short", "fan_out", "month_winners", "ingest", "calendar", "messages"))])
def test_query_equals_sql(spark, tables, sf, name):
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(tables.sql(catalog.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert catalog.queries().keys() <= __spark_entry__.queries().keys()


def test_questions_over_csv(spark, tmp_path):
    from tillspark import cli

    data = {
        "transactions": "h\nt1,1,1,,7.0,100,0,100,2024-03-01 07:00:00\nt2,1,1,,7,5,0,5,2024-08-01 08:00:00\nt3,1,1,,,5,0,500,2023-08-01 08:00:00\n",
        "transaction_items": "h\nt1,10,2,1,3.5,2024-03-01 07:00:00\n",
        "menu": "h\n10,Tea,x\n",
        "store": 'h\n1,"North,street\n',
        "users": "h\n7,f,1990-01-02\n",
    }
    for name, text in data.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_1.csv").write_text(text)
    from tillspark.config import Params
    from tillspark.operators.cleaners import clean
    from tillspark.plans.questions import large_transactions, run_all

    cleaned = {n: clean(scan_lines(spark, str(tmp_path / n), n), n) for n in selected_tables(",".join(data))}
    found = {n: sorted(map(tuple, df.collect())) for n, df in run_all(cleaned, Params()).items()}
    assert [r[0] for r in found[1]] == ["t1"] and found[3] == [("2024-H1", "1", 100.0), ("2024-H2", "1", 5.0)]
    assert found[2] == [("2024-03", "Tea", 0, 3.5), ("2024-03", "Tea", 2, 0.0)] and found[4] == [('"North', "1990-01-02")]
    assert large_transactions(cleaned["transactions"], Params(), narrow=True).columns == ["transaction_id", "final_amount"]
    with pytest.raises(FileNotFoundError):
        scan_lines(spark, str(tmp_path / "menu"), "nothing")
    with pytest.raises(ValueError, match="unknown tables"):
        selected_tables("menu,cities")
    data_dir, out = str(tmp_path), str(tmp_path / "out")
    cli.main([data_dir, out, "--tables", "transactions,menu"])
    assert spark.read.text(f"{out}/results_q1").count() == 1
    assert spark.read.text(f"{out}/results_q3").count() == 2
    assert not (tmp_path / "out" / "results_q2").exists()

"""Tables that are written for later questions, tagged messages, and one file a result."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillspark.config import Params
from tillspark.operators import filters, joins
from tillspark.sources import adapters, messages
from tillspark.sources.buckets import bucketed_lookup, write_bucketed, write_side
from tillspark.sources.calendar_table import of_months, read_calendar, write_calendar
from tillspark.sources.files import ORDER
from tillspark.sources.result_file import write_file
from tillspark.sources.schemas import CLEANED
from tillspark.sources.sinks import write_results


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def found(df):
    return sorted(map(str, map(tuple, df.collect())))


# Bucketed tables.
@pytest.fixture
def users(spark, tmp_path):
    rows = [(f" {k} ", f"19{50 + k % 50}-01-0{1 + k % 9}", k) for k in range(300)] + [("7", "2001-01-01", 900), (None, "x", 1)]
    side = spark.createDataFrame(rows, f"user_id string, birthdate string, {ORDER} long")
    write_side(side, "user_id", "birthdate", "users_test", str(tmp_path / "users"), 5)
    yield side
    spark.sql("DROP TABLE users_test")


def test_bucketed_lookup_equals_the_other(spark, users):
    left = spark.createDataFrame([("North", "7"), ("North", " 8"), ("South", "1999-01-01"), ("South", "unknown"), ("South", None)], "store_name string, user_id string")
    got = bucketed_lookup(left, spark, "users_test", "user_id", "birthdate")
    assert found(got) == found(joins.join_users(left, users)) and got.columns == ["store_name", "birthdate"]
    assert ("North", "2001-01-01") in [tuple(r) for r in got.collect()]


def test_users_are_not_shuffled(spark, users, tmp_path):
    left = spark.createDataFrame([(str(k % 400), k) for k in range(900)], "user_id string, n int")
    plan = plan_of(bucketed_lookup(left, spark, "users_test", "user_id", "birthdate"))
    below = plan[plan.index("FileScan parquet") - 400 :]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 1
    assert "Exchange" not in below.split("FileScan parquet")[0].split("Join")[-1].split("+- ")[-1]
    # and with the other side by the same buckets, nothing is
    write_bucketed(left.withColumn("_key", F.trim("user_id")), "_key", "left_test", str(tmp_path / "left"), 5)
    side = spark.table("users_test").withColumnRenamed("user_id", "_key").hint("merge")
    both = spark.table("left_test").join(side, "_key")
    assert both.count() == sum(k % 400 < 300 for k in range(900))
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].replace("BroadcastExchange", "")
    spark.sql("DROP TABLE left_test")


# The calendar.
def test_calendar_reads_the_months_asked(spark, sf, tmp_path):
    path = str(tmp_path / "calendar")
    orders = adapters.order_transactions(spark, sf)
    write_calendar(orders, path, spread=2)
    p = Params(from_year=1996, to_year=1996, from_hour=0, to_hour=23)
    got = read_calendar(spark, path, p)
    assert found(got.select(orders.columns)) == found(filters.filter_year(orders, 1996, 1996))
    plan = plan_of(got)
    assert "PartitionFilters: [isnotnull(year_month" in plan and "GreaterThanOrEqual(hour_of_day,0)" in plan
    assert read_calendar(spark, path).count() == orders.count()
    # files of other years may be anything, as they aren't opened
    for file in (tmp_path / "calendar").glob("year_month=*/*.parquet"):
        if "year_month=1996" not in str(file):
            file.write_bytes(b"not a table")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert got.count() == filters.filter_year(orders, 1996, 1996).count()


def test_months_are_chosen_as_the_query_runs(spark, sf, tmp_path):
    path = str(tmp_path / "calendar")
    orders = adapters.order_transactions(spark, sf)
    write_calendar(orders, path)
    months = spark.createDataFrame([("1996-02", "x"), ("1996-02", "y"), ("1997-05", "x"), ("2050-01", "x")], "year_month string, why string")
    got = of_months(read_calendar(spark, path), months.where("why < 'z'"))
    expected = orders.where("date_format(created_at, 'yyyy-MM') IN ('1996-02', '1997-05')")
    assert found(got.select(orders.columns)) == found(expected)
    assert "dynamicpruning" in plan_of(got)


def test_calendar_hours_and_rows_without_time(spark, tmp_path):
    rows = [("t1", "s", "u", 1.0, datetime(2024, 1, 31, 23, 0, 45)), ("t2", "s", "u", 1.0, datetime(2024, 1, 31, 23, 2, 15)), ("t3", "s", None, None, None), ("t4", "s", "u", 1.0, datetime(2025, 12, 31, 6))]
    frame = spark.createDataFrame(rows, CLEANED["transactions"])
    write_calendar(frame, str(tmp_path / "c"))
    assert [r.transaction_id for r in read_calendar(spark, str(tmp_path / "c"), Params()).orderBy("transaction_id").collect()] == ["t1", "t4"]
    assert read_calendar(spark, str(tmp_path / "c")).count() == 4


# Messages.
def test_messages_come_back_as_they_were(spark, tmp_path):
    tables = {
        "transactions": spark.createDataFrame([("t,1", 'a"b', None, 0.1, datetime(2024, 1, 2, 3, 4, 5)), ("t2", "é", "", float("nan"), None), ("t3", "s", "007", 1e300, datetime(1999, 12, 31))], CLEANED["transactions"]),
        "transaction_items": spark.createDataFrame([("1", 2**62, -0.5, datetime(2024, 1, 2)), (None, None, None, None)], CLEANED["transaction_items"]),
        "menu": spark.createDataFrame([("1", "Tea\n{}"), ("", "")], CLEANED["menu"]),
        "store": spark.createDataFrame([("1", "true"), ("12", "3.50")], CLEANED["store"]),
        "users": spark.createDataFrame([("1", "1990-01-02")], CLEANED["users"]),
    }
    path = str(tmp_path / "m")
    sent = messages.encode(tables, F.lit("c1")).unionByName(messages.end_of(spark, ["menu", "store"], "c1"))
    odd = ["", "no json", "[]", '{"type":"cities","payload":{"a":1}}', '{"type":"menu"}', '{"type":"menu","payload":3}', '{"payload":{"item_id":"1"}}', '{"type":"users","client":"c2","payload":{"user_id":"5","birthdate":["x"]}}']
    messages.route(sent.unionByName(spark.createDataFrame([(o,) for o in [*odd, None]], "value string")), path)
    for name, df in tables.items():
        got = messages.routed(spark, path, name).where("client = 'c1'").drop("client")
        assert found(got) == found(df) and got.dtypes == df.dtypes
    assert found(messages.routed(spark, path, "users").where("client = 'c2'")) == [str(("c2", "5", '["x"]'))]
    assert found(messages.ended(spark, path)) == [str(("c1", "menu")), str(("c1", "store"))]
    assert found(messages.unknown(spark, path)) == sorted(str((o,)) for o in [*odd[:-1], None])
    assert json.loads(sent.where(F.contains("value", F.lit("Tea"))).first().value) == {"type": "menu", "client": "c1", "payload": {"item_id": "1", "item_name": "Tea\n{}"}, "end": False}


def test_one_pass_without_a_shuffle(spark, sf, tmp_path):
    sent = messages.encode({"menu": adapters.part_menu(spark, sf)}, F.lit("c"))
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()


def test_a_message_is_walked_once(spark):
    """Routing takes the head of a message in one go, and doesn't describe a payload to see that it is an object."""
    plan = messages.parts(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 1
    assert "schema_of_variant" not in plan and "SchemaOfVariant" not in plan
    assert all(f"$.{field}" not in plan for field in ("type", "client", "end", "payload"))


def test_odd_messages_keep_their_parts(spark, tmp_path):
    """What counts as filled or ended, and the texts that odd heads have."""
    good = ['{"type":"menu","client":"c","payload":{}}', '{"type":"menu","client":7,"payload":{"item_id":1,"item_name":[2]},"end":null}', '{"type":"menu","client":{"a":1},"payload":{"item_id":"x","more":{"b":[1]}},"end":"x"}']
    ends = ['{"type":"store","client":"c","end":true}', '{"type":"users","client":"d","end":"true","payload":[1]}']
    odd = ['{"type":"menu","payload":"{}"}', '{"type":"menu","payload":[{}]}', '{"type":"menu","payload":null}', '{"type":1,"payload":{}}', '{"type":["menu"],"payload":{}}', '{"payload":{"type":"menu"}}', '[{"type":"menu","payload":{}}]', '"menu"', '{"type":"menu","payload":{}']
    messages.route(spark.createDataFrame([(v,) for v in [*good, *ends, *odd]], "value string"), str(tmp_path / "m"))
    assert found(messages.routed(spark, str(tmp_path / "m"), "menu")) == sorted(map(str, [("c", None, None), ("7", "1", "[2]"), ('{"a":1}', "x", None)]))
    assert found(messages.ended(spark, str(tmp_path / "m"))) == sorted(map(str, [("c", "store"), ("d", "users")]))
    assert found(messages.unknown(spark, str(tmp_path / "m"))) == sorted(str((v,)) for v in odd)


# One file a result.
def test_result_file(spark, tmp_path):
    path = tmp_path / "results_q1.txt"
    write_file(spark.range(1000).orderBy(F.desc("id")).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("line")), str(path))
    assert path.read_text() == "\n".join(f"é{k}" for k in range(999, -1, -1))
    write_file(spark.createDataFrame([("a",), (None,), ("b",)], "line string").coalesce(1), str(path))
    assert path.read_text() == "a\n\nb"
    write_file(spark.createDataFrame([], "line string"), str(path))
    assert path.read_text() == "" and [p.name for p in tmp_path.iterdir()] == ["results_q1.txt"]


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    path = tmp_path / "results_q1.txt"
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") < 99, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("stopped"))).alias("line"))
    with pytest.raises(Exception, match="stopped"):
        write_file(bad, str(path))
    assert list(tmp_path.iterdir()) == []
    path.write_text("old")
    with pytest.raises(Exception, match="stopped"):
        write_file(bad, str(path))
    assert path.read_text() == "old"


def test_results_as_files(spark, tmp_path):
    write_results({3: spark.createDataFrame([("2024-H1", "1", 2.5)], "semester string, store_id string, tpv double")}, str(tmp_path), one_file=True)
    assert (tmp_path / "results_q3.txt").read_text() == "2024-H1,1,2.500000"
    with pytest.raises(ValueError, match="no such question"):
        write_results({5: spark.range(1)}, str(tmp_path))

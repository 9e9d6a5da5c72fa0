from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillspark.config import Params
from tillspark.operators.aggregates import aggregate, merged, month_items, semester_stores, store_users
from tillspark.operators.cleaners import clean
from tillspark.operators.filters import apply_filter, filter_amount, filter_hour, filter_known_user, filter_year
from tillspark.operators.joins import lookup, name_lookup, passthrough_lookup
from tillspark.operators.ranking import best_sellers, top_buyers, top_earners, top_k
from tillspark.sources.schemas import CLEANED
from tillspark.sources.sinks import as_lines, semester_json, write_results


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def transactions(spark, *rows):
    return spark.createDataFrame([(f"t{k}", *r) for k, r in enumerate(rows)], CLEANED["transactions"])


def at(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


GOOD = "id1,5,1,,{user},10,0,9.5,2024-07-01 07:00:00"


@pytest.mark.parametrize(("user", "found"), [("77", "77"), ("77.0", "77"), ("", None)])
def test_clean_transactions_user(spark, user, found):
    row = clean(lines(spark, GOOD.format(user=user) + ",extra"), "transactions").first()
    assert row.user_id == found and row.final_amount == 9.5 and row.created_at == at("2024-07-01 07:00:00")


@pytest.mark.parametrize("bad", ["", "1,2,3,4,5,6,7,8"])
def test_clean_fails_or_drops_short_lines(spark, bad):
    rows = lines(spark, GOOD.format(user=1), bad)
    with pytest.raises(Exception, match="under 9 fields"):
        clean(rows, "transactions").collect()
    assert clean(rows, "transactions", "drop").count() == 1


def test_clean_items_and_side_tables(spark):
    items = clean(lines(spark, "t,7,3,1.5,4.5,2024-01-02 03:04:05", "t,7,3.0,1.5,75d,nonsense", "t,8,x,,NaN?,2024-01-02 03:04:05"), "transaction_items").collect()
    assert [(r.item_id, r.quantity, r.subtotal) for r in items] == [("7", 3, 4.5), ("7", None, None), ("8", None, None)]
    assert clean(lines(spark, "1,Tea,x"), "menu").first() == ("1", "Tea")
    assert clean(lines(spark, "1,North,street"), "store").first() == ("1", "North")
    assert clean(lines(spark, "1,f,1990-02-03"), "users").first() == ("1", "1990-02-03")
    assert clean(lines(spark), "menu").count() == 0
    assert clean(lines(spark, "kept"), "other").first().value == "kept"


@pytest.mark.parametrize(
    ("time", "compat", "strict"),
    [("06:15:00", 1, 1), ("00:02:21", 0, 0), ("22:01:54", 1, 1), ("23:00:00", 1, 1), ("23:02:15", 0, 0), ("23:30:00", 1, 0), ("23:00:45", 1, 0)],
)
def test_filter_hour(spark, time, compat, strict):
    rows = transactions(spark, ("s", "u", 1.0, at(f"2024-03-01 {time}")))
    assert filter_hour(rows, 6, 23).count() == compat
    assert filter_hour(rows, 6, 23, "strict").count() == strict
    assert filter_hour(rows, 24, 25).count() == 0


def test_filter_year_amount_user(spark):
    rows = transactions(spark, ("s", "u", 75.0, at("2024-01-01 00:00:00")), ("s", "", 74.99, at("2025-12-31 23:59:59")), ("s", None, None, at("2026-01-01 00:00:00")), ("s", "v", float("nan"), None))
    assert filter_year(rows, 2024, 2025).count() == 2
    assert [r.transaction_id for r in filter_amount(rows, 75).collect()] == ["t0", "t3"]
    assert [r.user_id for r in filter_known_user(rows).collect()] == ["u", "v"]
    assert apply_filter(rows, "amount", Params()).count() == 2
    with pytest.raises(ValueError, match="unknown filter"):
        apply_filter(rows, "colour", Params())


def test_year_range_reaches_the_scan(spark, sf):
    from tillspark.sources.adapters import event_transactions

    plan = filter_year(event_transactions(spark, sf), 2024, 2025)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_aggregates(spark):
    items = spark.createDataFrame([("1", 2, 1.0, at("2024-06-30 00:00:00")), ("1", 3, 0.1, at("2024-06-01 00:00:00")), ("2", None, 5.0, at("2024-06-01 00:00:00")), ("2", 1, None, at("2024-06-01 00:00:00"))], CLEANED["transaction_items"])
    assert [tuple(r) for r in month_items(items).collect()] == [("2024-06", "1", 5, 1.1)]
    rows = transactions(spark, ("a", "u", 0.1, at("2024-06-30 00:00:00")), ("a", "u", 0.2, at("2024-07-01 00:00:00")), ("a", None, 1.0, at("2024-07-01 00:00:00")), ("b", "", 1.0, at("2024-07-01 00:00:00")), ("a", "v", None, at("2024-07-01 00:00:00")))
    assert sorted(map(tuple, semester_stores(rows).collect())) == [("2024-H1", "a", 0.1), ("2024-H2", "a", 1.2), ("2024-H2", "b", 1.0)]
    assert [tuple(r) for r in store_users(rows).collect()] == [("a", "u", 2)]
    parts = [semester_stores(rows.where("user_id = 'u'")), semester_stores(rows.where("user_id is null or user_id <> 'u'"))]
    assert sorted(map(tuple, merged(parts, ["semester", "store_id"], ["tpv"]).collect())) == sorted(map(tuple, semester_stores(rows).collect()))
    with pytest.raises(ValueError, match="unknown group"):
        aggregate(rows, "week")


def test_arg_max_ties_and_zeroed_measures(spark):
    groups = spark.createDataFrame([("2024-01", "10", 5, 1.0), ("2024-01", "9", 5, 7.0), ("2024-02", "1", 0, -2e9)], "year_month string, item_id string, total_quantity long, total_profit double")
    assert sorted(map(tuple, best_sellers(groups).collect())) == [("2024-01", "9", 5, 0.0), ("2024-02", "1", 0, 0.0)]
    assert [tuple(r) for r in top_earners(groups).collect()] == [("2024-01", "9", 0, 7.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=st.lists(st.integers(-3, 9), max_size=9), k=st.integers(1, 4), parts=st.integers(1, 3))
def test_top_k_property(spark, counts, k, parts):
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate(counts)], "g string, i int, c int").repartition(parts)
    expected = sorted(enumerate(counts), key=lambda x: (-x[1], x[0]))[:k]
    assert sorted((r.i, r.c) for r in top_k(rows, ["g"], "c", ["i"], k).collect()) == sorted(expected)


def test_top_buyers(spark):
    rows = spark.createDataFrame([("s", "10", 2), ("s", "9", 2), ("s", "8", 3), ("t", "1", 1)], "store_id string, user_id string, purchases long")
    assert sorted(map(tuple, top_buyers(rows, 2).select("store_id", "user_id", "rank").collect())) == [("s", "8", 1), ("s", "9", 2), ("t", "1", 1)]
    with pytest.raises(ValueError):
        top_buyers(rows, 0)
    with pytest.raises(ValueError):
        Params(k=0)


def test_name_lookup(spark):
    left = spark.createDataFrame([("m", " 1 ", 5), ("m", "2", 6), ("m", "3", 7), ("m", None, 8)], "ym string, item_id string, q int")
    menu = spark.createDataFrame([("1", "Tea", 1), ("1", "Chai", 2), ("2", "", 1)], "item_id string, item_name string, n int")
    assert [tuple(r) for r in name_lookup(left, menu, "item_id", "item_name", "n").collect()] == [("m", "Chai", 5)]
    assert lookup(left, menu.limit(0), "items").count() == 0 and lookup(left.limit(0), menu, "items").count() == 0
    with pytest.raises(ValueError, match="unknown join"):
        lookup(left, menu, "cities")


def test_passthrough_lookup(spark):
    left = spark.createDataFrame([("s", "1"), ("s", "1"), ("s", "2"), ("s", "1990-01-01")], "store_name string, user_id string")
    users = spark.createDataFrame([("1", "1980-02-02"), ("1990-01-01", "no")], "user_id string, birthdate string")
    found = sorted(map(tuple, passthrough_lookup(left, users, "user_id", "birthdate").collect()))
    assert found == [("s", "1980-02-02"), ("s", "1980-02-02"), ("s", "1990-01-01"), ("s", "2")]
    assert sorted(map(tuple, passthrough_lookup(left, users.limit(0), "user_id", "birthdate").collect())) == sorted(map(tuple, left.collect()))


def test_sinks(spark, tmp_path):
    totals = spark.createDataFrame([("2024-H1", "b", 1.5), ("2024-H1", "a", 2.0)], "semester string, store_id string, tpv double")
    assert sorted(r.line for r in as_lines(totals).collect()) == ["2024-H1,a,2.000000", "2024-H1,b,1.500000"]
    assert semester_json(totals).first().json == '{"2024-H1":["a,2.000000","b,1.500000"]}'
    write_results({3: totals}, str(tmp_path))
    write_results({3: totals}, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/results_q3").count() == 2
    with pytest.raises(ValueError):
        write_results({5: totals}, str(tmp_path))


def test_totals_keep_small_and_large_amounts(spark):
    def tpv(*amounts):
        return semester_stores(transactions(spark, *(("s", "u", a, at("2024-01-01 00:00:00")) for a in amounts))).first().tpv

    assert tpv(*[0.004] * 1000) == 4.0
    assert tpv(1e16, 2e16) == 3e16 and tpv(1e30, 0.5) == 1e30
    assert tpv(0.1, 0.2) == 0.3
    assert tpv(float("nan"), 1.0) != tpv(float("nan"), 1.0)


@pytest.mark.parametrize("text", ["2024-07-01", "2024", "2024-07-01T07:00:00", "2024-13-01 07:00:00", ""])
def test_a_timestamp_has_a_date_and_a_time(spark, text):
    assert clean(lines(spark, f"t,7,3,1.5,4.5,{text}"), "transaction_items").first().created_at is None


def test_blank_names_go_and_the_last_line_wins(spark, tmp_path):
    from tillspark.sources.files import scan_lines

    (tmp_path / "menu_a.csv").write_text("id,name,x\n1,Tea,x\n2,  ,x\n1,Chai ,x\n3,Zen,x\n")
    (tmp_path / "menu_b.csv").write_text("id,name,x\n3,Ale,x\n\n")
    menu = clean(scan_lines(spark, str(tmp_path), "menu", order=True), "menu")
    left = spark.createDataFrame([("1",), ("2",), ("3",)], "item_id string")
    assert sorted(r.item_name for r in lookup(left, menu, "items").collect()) == ["Ale", "Chai"]
    with pytest.raises(Exception, match="under 2 fields"):
        clean(scan_lines(spark, str(tmp_path), "menu", blank=True), "menu").collect()
    with pytest.raises(FileNotFoundError):
        scan_lines(spark, str(tmp_path), "[menu]")


def test_json_both_ways(spark):
    from tillspark.sources.sinks import from_semester_json

    totals = spark.createDataFrame([("2024-H1", "b", 1.5), ("2024-H1", "a", 2.0)], "semester string, store_id string, tpv double")
    assert sorted(map(tuple, from_semester_json(semester_json(totals)).collect())) == sorted(map(tuple, totals.collect()))
    assert from_semester_json(lines(spark, "no json", None).withColumnRenamed("value", "json")).count() == 0


@pytest.mark.parametrize(("text", "parts", "found"), [("a,b,c", 2, ["a", "b,c"]), ("a", 2, ["a"]), ("", 2, [""]), (",", 2, ["", ""]), ("a,b,c", 1, ["a,b,c"]), (None, 2, None)])
def test_split_first(spark, text, parts, found):
    from tillspark.functions.parsing import split_first

    assert lines(spark, text).select(split_first("value", parts)).first()[0] == found
    with pytest.raises(ValueError, match="above 0"):
        split_first("value", 0)


def test_client_ids(spark):
    from tillspark.functions.ids import new_client_id, short_id

    made = [new_client_id() for _ in range(3)]
    assert len(set(made)) == 3
    rows = lines(spark, *made, "ab", "", None).select("value", short_id("value").alias("short")).collect()
    assert [r.short for r in rows] == [m.replace("-", "")[:8] for m in made] + ["ab", "", None]


def test_maps_of_groups(spark):
    from tillspark.operators.aggregates import as_maps

    groups = spark.createDataFrame([("c", "b", 2.0), ("c", "a", 1.0), ("d", "a", None), ("e", None, 3.0)], "client string, store string, tpv double")
    assert {r.client: r.entries for r in as_maps(groups, ["client"], "store", "tpv").collect()} == {"c": {"a": 1.0, "b": 2.0}, "d": {"a": None}}

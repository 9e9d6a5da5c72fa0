"""What plans look like, as run, and that other shapes of a question give the same rows."""

from __future__ import annotations

import pytest

from tillspark.config import Params
from tillspark.operators import aggregates, filters, ranking
from tillspark.plans import catalog, questions
from tillspark.sources import adapters
from tillspark.sources.files import scan_parquet


def plan_of(df) -> str:
    """The final adaptive plan."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def found(df):
    """Rows in order; nan equals itself, and zero has no sign."""
    return sorted(str(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in df.collect())


def test_month_products_scan_items_once(spark, sf):
    plan = plan_of(catalog.queries()["q2_products"](spark, sf))
    assert plan.count("FileScan parquet") == 2 and "Window" not in plan  # lineitem and part
    assert "GreaterThanOrEqual(l_shipdate" in plan
    items = adapters.numbered_items(scan_parquet(spark, sf, "lineitem"))
    ranked = plan_of(ranking.month_winners(aggregates.month_items(items)))
    assert ranked.count("FileScan parquet") == 1 and "SortAggregate" not in ranked and "Sort [" not in ranked and "HashAggregate" in ranked


@pytest.mark.parametrize("numeric", [True, False])
def test_month_winners_are_those_of_each_measure(spark, numeric):
    rows = [("2024-01", 10, 5, 1.0), ("2024-01", 9, 5, 7.0), ("2024-01", 11, 4, 7.0), ("2024-02", 1, 0, -2e9), ("2024-03", 2, -1, -1e9), ("2024-04", 3, -5, float("nan")), ("2024-04", 4, 7, 1e300), ("2024-05", 5, 0, 0.0), ("2024-05", 4, 0, -0.0)]
    groups = spark.createDataFrame(rows, "year_month string, item_id long, total_quantity long, total_profit double")
    text = groups.withColumn("item_id", groups.item_id.cast("string"))
    expected = found(ranking.best_sellers(text).unionByName(ranking.top_earners(text)))
    got = ranking.month_winners(groups if numeric else text)
    assert found(got.withColumn("item_id", got.item_id.cast("string"))) == expected
    if not numeric:
        odd = spark.createDataFrame([("2024-01", "b", 5, 1.0), ("2024-01", "a", 5, 1.0), ("2024-01", "7", 5, 1.0)], groups.schema.simpleString().replace("struct<", "").replace(">", "").replace("item_id:bigint", "item_id:string"))
        assert found(ranking.month_winners(odd)) == found(ranking.best_sellers(odd).unionByName(ranking.top_earners(odd)))


def test_month_winners_of_random_groups(spark, sf):
    groups = aggregates.month_items(adapters.line_items(spark, sf)).withColumn("total_quantity", (aggregates.F.col("total_quantity") / 40).cast("long"))
    numbers = groups.withColumn("item_id", groups.item_id.cast("long"))
    got = ranking.month_winners(numbers)
    assert found(got.withColumn("item_id", got.item_id.cast("string"))) == found(ranking.best_sellers(groups).unionByName(ranking.top_earners(groups)))


def test_fan_out_scans_once_and_shuffles_once(spark, sf):
    fan = questions.fan_out(adapters.event_transactions(spark, sf), Params())
    plan = plan_of(fan)
    assert plan.count("FileScan parquet") == 1 and plan.count("Expand") == 1 and plan.count("Exchange") == 1
    assert "GreaterThanOrEqual(ts" in plan


@pytest.mark.parametrize("params", [Params(), Params(from_hour=9, to_hour=11, hour_mode="strict"), Params(from_year=1990, to_year=1991), Params(from_hour=24, to_hour=25)])
def test_fan_out_equals_the_questions(spark, sf, params):
    rows = adapters.event_transactions(spark, sf)
    rows = rows.withColumn("user_id", aggregates.F.when(aggregates.F.col("user_id").cast("long") % 5 != 0, rows.user_id))
    fan = questions.fan_out(rows, params)
    assert found(questions.totals_of(fan)) == found(questions.semester_totals(rows, params))
    counts = aggregates.store_users(filters.filter_year(rows, params.from_year, params.to_year))
    assert found(fan.where("question = 4").select("store_id", "user_id", "purchases")) == found(counts)


def test_run_all_with_and_without_one_pass(spark, sf):
    tables = {
        "transactions": adapters.event_transactions(spark, sf), "transaction_items": adapters.line_items(spark, sf), "menu": adapters.part_menu(spark, sf),
        "store": scan_parquet(spark, sf, "events").select(aggregates.F.col("event_type").alias("store_id"), aggregates.F.upper("event_type").alias("store_name")).distinct(), "users": adapters.customer_users(spark, sf),
    }
    staged = []
    apart, together = questions.run_all(tables, Params()), questions.run_all(tables, Params(), lambda df: staged.append(df) or df)
    assert len(staged) == 1 and {n: found(df) for n, df in apart.items()} == {n: found(df) for n, df in together.items()}

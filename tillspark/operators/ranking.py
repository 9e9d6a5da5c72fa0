"""Top rows of groups, with ties broken by ascending id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], best: str, tie: list[str], k: int) -> DataFrame:
    """At most ``k`` rows of each group with the largest ``best``, and their rank."""
    if k <= 0:
        raise ValueError("k must be above 0")
    order: list[Column] = [F.col(best).desc(), *(F.col(t).asc() for t in tie)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def id_order(column: str) -> Column:
    """Ids that are whole numbers in the order of the numbers."""
    return F.col(column).try_cast("bigint")


def best_sellers(groups: DataFrame, *by: str) -> DataFrame:
    """The item of each month with the largest quantity; its profit is shown as 0."""
    top = _first(groups.where("total_quantity > -1"), "total_quantity", by)
    return top.withColumn("total_profit", F.lit(0.0))


def top_earners(groups: DataFrame, *by: str) -> DataFrame:
    """The item of each month with the largest profit; its quantity is shown as 0."""
    top = _first(groups.where("total_profit > -1e9"), "total_profit", by)
    return top.withColumn("total_quantity", F.lit(0).cast("bigint"))


def month_winners(groups: DataFrame, *by: str) -> DataFrame:
    """The best seller and the top earner of each month: the rows of ``best_sellers`` and ``top_earners``.

    One pass, in aggregates that merge: the smallest id of each value of a measure first, which settles ties,
    then the ids of the largest values.  Where item_id is a bigint, all of it are hash aggregates.
    """
    keys = [*by, "year_month"]
    numeric = dict(groups.dtypes)["item_id"] == "bigint"
    item = F.col("item_id") if numeric else F.struct(id_order("item_id").alias("id"), "item_id")
    measures = F.explode(F.array(F.struct(F.col("total_quantity").alias("q"), F.lit(None).cast("double").alias("p")), F.struct(F.lit(None).cast("bigint").alias("q"), F.col("total_profit").alias("p"))))
    values = groups.select(*keys, item.alias("item"), measures.alias("m")).select(*keys, "item", "m.q", "m.p").where("q > -1 OR p > -1e9")
    firsts = values.groupBy(*keys, "q", "p").agg(F.min("item").alias("item"))
    best = firsts.groupBy(*keys).agg(F.max("q").alias("q"), F.max_by("item", "q").alias("q_item"), F.max("p").alias("p"), F.max_by("item", "p").alias("p_item"))
    seller = F.struct(F.col("q_item").alias("item"), F.col("q").alias("total_quantity"), F.when(F.col("q").isNotNull(), 0.0).alias("total_profit"))
    earner = F.struct(F.col("p_item").alias("item"), F.when(F.col("p").isNotNull(), 0).cast("bigint").alias("total_quantity"), F.col("p").alias("total_profit"))
    rows = best.select(*keys, F.explode(F.array(seller, earner)).alias("w")).where("w.total_quantity IS NOT NULL AND w.total_profit IS NOT NULL")
    return rows.select(*keys, (F.col("w.item") if numeric else F.col("w.item.item_id")).alias("item_id"), "w.total_quantity", "w.total_profit")


def _first(groups: DataFrame, best: str, by: tuple[str, ...]) -> DataFrame:
    keyed = groups.withColumn("_id", id_order("item_id"))
    return top_k(keyed, [*by, "year_month"], best, ["_id", "item_id"], 1).drop("rank", "_id")


def top_buyers(groups: DataFrame, k: int, *by: str) -> DataFrame:
    """The users of each store with the most purchases; a store with fewer than ``k`` has all of them."""
    keyed = groups.where("purchases > 0").withColumn("_id", id_order("user_id"))
    return top_k(keyed, [*by, "store_id"], "purchases", ["_id", "user_id"], k).drop("_id")

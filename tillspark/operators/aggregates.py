"""The three grouped aggregations.

Rows whose key or measure didn't parse (null) don't count.  With ``by`` (as a client's id) every group is kept
apart by those columns too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import semester, year_month
from ..functions.parsing import total


def month_items(items: DataFrame, *by: str) -> DataFrame:
    """Quantity and profit per month and item."""
    good = items.where("quantity IS NOT NULL AND subtotal IS NOT NULL AND created_at IS NOT NULL")
    keyed = good.select(*by, year_month(F.col("created_at")).alias("year_month"), "item_id", "quantity", "subtotal")
    sums = keyed.groupBy(*by, "year_month", "item_id").agg(F.sum("quantity").alias("total_quantity"), total(F.col("subtotal")).alias("total_profit"))
    return sums


def semester_stores(transactions: DataFrame, *by: str) -> DataFrame:
    """Total payment value per semester and store."""
    good = transactions.where("final_amount IS NOT NULL AND created_at IS NOT NULL")
    keyed = good.select(*by, semester(F.col("created_at")).alias("semester"), "store_id", "final_amount")
    return keyed.groupBy(*by, "semester", "store_id").agg(total(F.col("final_amount")).alias("tpv"))


def store_users(transactions: DataFrame, *by: str) -> DataFrame:
    """Purchases per store and known user."""
    good = transactions.where("final_amount IS NOT NULL AND created_at IS NOT NULL AND user_id IS NOT NULL AND user_id <> ''")
    return good.groupBy(*by, "store_id", "user_id").agg(F.count("*").alias("purchases"))


def merged(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """One aggregate from partial ones with the same keys."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    kinds = dict(out.dtypes)
    return out.groupBy(*keys).agg(*((total(F.col(c)) if kinds[c] == "double" else F.sum(c)).alias(c) for c in sums))


def as_maps(groups: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """One map from ``key`` to ``value`` for each ``by``, in order of the key.

    ``groups`` has a row per ``by`` and ``key``; a ``by`` with very many keys belongs in rows, not in a map.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return groups.where(F.col(key).isNotNull()).groupBy(*by).agg(F.map_from_entries(entries).alias("entries"))


AGGREGATES: dict[str, Callable[..., DataFrame]] = {"yearmonth": month_items, "semester": semester_stores, "store": store_users}


def aggregate(df: DataFrame, kind: str, *by: str) -> DataFrame:
    if kind not in AGGREGATES:
        raise ValueError(f"unknown group type: {kind}")
    return AGGREGATES[kind](df, *by)

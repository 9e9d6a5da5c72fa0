"""The four questions over cleaned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.calendar import semester
from ..functions.parsing import total
from ..operators.aggregates import month_items, semester_stores, store_users
from ..operators.filters import filter_amount, filter_hour, filter_year, in_hours, known_user
from ..operators.joins import join_items, join_stores, join_users
from ..operators.ranking import best_sellers, month_winners, top_buyers, top_earners


def _years(df: DataFrame, p: Params) -> DataFrame:
    return filter_year(df, p.from_year, p.to_year)


def _hours(df: DataFrame, p: Params) -> DataFrame:
    return filter_hour(_years(df, p), p.from_hour, p.to_hour, p.hour_mode)


def large_transactions(transactions: DataFrame, p: Params, narrow: bool = False) -> DataFrame:
    """Question 1: transactions in the years and hours of at least the amount; one stage, no shuffle."""
    found = filter_amount(_hours(transactions, p), p.min_amount)
    return found.select("transaction_id", "final_amount") if narrow else found


def month_products(items: DataFrame, menu: DataFrame, p: Params) -> DataFrame:
    """Question 2: the best seller and the top earner of each month, each with the other measure as 0.

    One pass over the items; ranking goes before the lookup, so that two rows a month are joined.
    """
    return join_items(month_winners(month_items(_years(items, p))), menu)


def month_best_sellers(items: DataFrame, menu: DataFrame, p: Params) -> DataFrame:
    return join_items(best_sellers(month_items(_years(items, p))), menu).drop("total_profit")


def month_top_earners(items: DataFrame, menu: DataFrame, p: Params) -> DataFrame:
    return join_items(top_earners(month_items(_years(items, p))), menu).drop("total_quantity")


def semester_totals(transactions: DataFrame, p: Params) -> DataFrame:
    """Question 3: total payment value per semester and store."""
    return semester_stores(_hours(transactions, p))


def buyers_birthdays(transactions: DataFrame, stores: DataFrame, users: DataFrame, p: Params) -> DataFrame:
    """Question 4: birthdays of the k best buyers of each store (or the id of an unknown user)."""
    top = top_buyers(store_users(_years(transactions, p)), p.k).select("store_id", "user_id", "rank")
    return join_users(join_stores(top, stores), users)


def fan_out(transactions: DataFrame, p: Params) -> DataFrame:
    """The groups of questions 3 and 4 in one pass: question, semester, store_id, user_id, tpv, purchases.

    Two grouping sets, each with its own filter: semester and store over the hours, store and user over known
    users.  A row is expanded once, summed where it is, and meets its group in one shuffle.
    """
    rows = _years(transactions, p).where("final_amount IS NOT NULL")
    keyed = rows.select(semester(F.col("created_at")).alias("semester"), "store_id", "user_id", "final_amount", in_hours(p.from_hour, p.to_hour, p.hour_mode).alias("_open"), known_user().alias("_known"))
    groups = keyed.where("_open OR _known").groupingSets([["semester", "store_id"], ["store_id", "user_id"]], "semester", "store_id", "user_id")
    sums = groups.agg(
        F.grouping("user_id").alias("_third"),
        F.count_if("_open").alias("_n"),
        total(F.when(F.col("_open"), F.col("final_amount"))).alias("tpv"),
        F.count_if("_known").alias("purchases"),
    )
    third = F.col("_third") == 1
    kept = sums.where(F.when(third, F.col("_n") > 0).otherwise(F.col("purchases") > 0))
    return kept.select(F.when(third, 3).otherwise(4).alias("question"), "semester", "store_id", "user_id", F.when(third, F.col("tpv")).alias("tpv"), F.when(~third, F.col("purchases")).alias("purchases"))


def totals_of(fan: DataFrame) -> DataFrame:
    """Question 3 from ``fan_out``."""
    return fan.where("question = 3").select("semester", "store_id", "tpv")


def birthdays_of(fan: DataFrame, stores: DataFrame, users: DataFrame, p: Params) -> DataFrame:
    """Question 4 from ``fan_out``."""
    counts = fan.where("question = 4").select("store_id", "user_id", "purchases")
    return join_users(join_stores(top_buyers(counts, p.k).select("store_id", "user_id", "rank"), stores), users)


def run_all(tables: dict[str, DataFrame], p: Params, stage: Callable[[DataFrame], DataFrame] | None = None) -> dict[int, DataFrame]:
    """By number, those of the four whose tables are among the cleaned ``tables`` (by name).

    With ``stage``, which writes a table and reads it again, questions 3 and 4 share one pass over the
    transactions.
    """
    asked = {
        1: (large_transactions, ["transactions"]),
        2: (month_products, ["transaction_items", "menu"]),
        3: (semester_totals, ["transactions"]),
        4: (lambda *x: buyers_birthdays(*x).drop("rank"), ["transactions", "store", "users"]),
    }
    found = {n: f(*(tables[t] for t in names), p) for n, (f, names) in asked.items() if tables.keys() >= set(names)}
    if stage and 3 in found and 4 in found:
        fan = stage(fan_out(tables["transactions"], p))
        found |= {3: totals_of(fan), 4: birthdays_of(fan, tables["store"], tables["users"], p).drop("rank")}
    return found

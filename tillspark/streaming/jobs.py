"""The questions over arriving files: each takes what is there, and goes on from its checkpoint later.

Stateless results are appended.  Aggregates are kept as partial tables (see ``partials``); ranking and lookups
are done when the answer is read, over the merged groups and the side tables as they are then.  The streams
with state are made in a session of ``state.state_session``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..config import Params
from ..operators.aggregates import month_items, semester_stores, store_users
from ..operators.filters import filter_hour, filter_year
from ..operators.joins import join_items, join_stores, join_users
from ..operators.ranking import month_winners, top_buyers
from ..plans.questions import large_transactions
from .ends import groups_at_end
from .partials import read_partials, write_partials


def _schema(**kinds: type) -> StructType:
    return StructType([StructField(n, k()) for n, k in kinds.items()])


SEMESTERS = _schema(semester=StringType, store_id=StringType, tpv=DoubleType)
MONTHS = _schema(year_month=StringType, item_id=StringType, total_quantity=LongType, total_profit=DoubleType)
STORES = _schema(store_id=StringType, user_id=StringType, purchases=LongType)


def appended(rows: DataFrame, out: str, checkpoint: str) -> None:
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_large_transactions(transactions: DataFrame, p: Params, out: str, checkpoint: str) -> None:
    appended(large_transactions(transactions, p), out, checkpoint)


def stream_semester_totals(transactions: DataFrame, p: Params, out: str, checkpoint: str) -> None:
    rows = filter_hour(filter_year(transactions, p.from_year, p.to_year), p.from_hour, p.to_hour, p.hour_mode)
    write_partials(semester_stores(rows), out, checkpoint)


def semester_totals(spark: SparkSession, out: str) -> DataFrame:
    return read_partials(spark, out, SEMESTERS, ["semester", "store_id"])


def stream_month_items(items: DataFrame, p: Params, out: str, checkpoint: str) -> None:
    write_partials(month_items(filter_year(items, p.from_year, p.to_year)), out, checkpoint)


def month_products(spark: SparkSession, out: str, menu: DataFrame) -> DataFrame:
    return join_items(month_winners(read_partials(spark, out, MONTHS, ["year_month", "item_id"])), menu)


def stream_store_users(transactions: DataFrame, p: Params, out: str, checkpoint: str) -> None:
    write_partials(store_users(filter_year(transactions, p.from_year, p.to_year)), out, checkpoint)


def buyers_birthdays(spark: SparkSession, out: str, stores: DataFrame, users: DataFrame, p: Params) -> DataFrame:
    groups = read_partials(spark, out, STORES, ["store_id", "user_id"])
    return join_users(join_stores(top_buyers(groups, p.k).select("store_id", "user_id", "rank"), stores), users)


def stream_client_totals(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Semester totals of each client whose input ended; ``rows``: client_id, semester, store_id, tpv, is_end."""
    appended(groups_at_end(rows, ["semester", "store_id"], ["tpv"]), out, checkpoint)

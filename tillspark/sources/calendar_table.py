"""Transactions laid out by the calendar: a folder a month, rows in order of the hour.

A question about years reads the folders of their months alone, and within a file the row groups of the hours
asked.  Months are dealt to ``spread`` tasks each, so that a large month is no large task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..functions.calendar import year_month
from ..operators.filters import filter_hour, filter_year

MONTH, HOUR = "year_month", "hour_of_day"


def write_calendar(transactions: DataFrame, path: str, spread: int = 8) -> None:
    """Rows without a time go to a folder of their own; every other column is kept."""
    rows = transactions.withColumns({MONTH: year_month(F.col("created_at")), HOUR: F.hour("created_at")})
    share = F.pmod(F.xxhash64(*transactions.columns), F.lit(spread))
    n = int(transactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, MONTH, share).sortWithinPartitions(MONTH, HOUR, "created_at")
    dealt.write.mode("overwrite").partitionBy(MONTH).parquet(path)


def read_calendar(spark: SparkSession, path: str, p: Params | None = None) -> DataFrame:
    """The rows, with ``year_month`` and ``hour_of_day``; those of the years and hours of ``p``, where given."""
    rows = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))
    if p is None:
        return rows
    months = rows.where(F.col(MONTH).between(f"{p.from_year:04d}-01", f"{p.to_year:04d}-12") & F.col(HOUR).between(p.from_hour, p.to_hour))
    return filter_hour(filter_year(months, p.from_year, p.to_year), p.from_hour, p.to_hour, p.hour_mode)


def of_months(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of the months in a table (year_month), whose folders are chosen as the query runs.

    ``months`` has at most a row a month, so it is small whatever the transactions are.
    """
    asked = months.select(F.col(MONTH).cast("string").alias(MONTH)).distinct()
    return rows.join(F.broadcast(asked), MONTH, "left_semi")

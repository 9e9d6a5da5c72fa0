"""Calendar buckets and time parts of timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(at: Column) -> Column:
    """`yyyy-MM`."""
    return F.date_format(at, "yyyy-MM")


def semester(at: Column) -> Column:
    """`yyyy-H1` up to June, `yyyy-H2` from July."""
    return F.concat(F.date_format(at, "yyyy"), F.when(F.month(at) <= 6, "-H1").otherwise("-H2"))


def time_parts(at: Column) -> list[Column]:
    return [F.year(at).alias("year"), F.hour(at).alias("hour"), F.minute(at).alias("minute"), F.second(at).alias("second")]

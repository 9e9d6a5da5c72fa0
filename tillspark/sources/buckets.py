"""Tables that are written once by their join key, so that later joins on it move nothing of them.

Rows are dealt by the hash that Spark's buckets use, one task and file a bucket, in order of the key.  Two tables
with the same number of buckets join without a shuffle; of another table only its own rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import last_wins


def write_bucketed(df: DataFrame, key: str, name: str, path: str, buckets: int) -> None:
    """Writes ``df`` to ``path``, known as table ``name`` to the session; replaces a table of that name."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def write_side(side: DataFrame, key: str, value: str, name: str, path: str, buckets: int, order: str | None = None) -> None:
    """A side table by its trimmed key: one row a key, the one that comes last."""
    write_bucketed(last_wins(side, key, value, order).where(F.col(key).isNotNull()), key, name, path, buckets)


def bucketed_lookup(left: DataFrame, spark: SparkSession, name: str, key: str, value: str) -> DataFrame:
    """``left`` with ``key`` replaced by the value of the side table ``name`` where there is one, as column
    ``value``; a key that has a value's form already (it holds a dash) stays.

    The side table was written by ``write_side``, and neither it is shuffled nor reduced again.
    """
    side = spark.table(name).select(F.col(key).alias("_key"), F.col(value).alias("_value")).hint("merge")
    found = left.withColumn("_key", F.trim(key)).join(side, "_key", "left")
    shown = F.when(F.contains(F.col(key), F.lit("-")), F.col(key)).otherwise(F.coalesce("_value", key))
    return found.select(*(shown.alias(value) if c == key else c for c in left.columns))

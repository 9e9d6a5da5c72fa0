"""Incremental aggregates: a stream's changed groups as one partial table a batch, merged when they are read.

A batch writes the groups that it changed, with their totals so far, to the partition of its number.  The
totals are kept in the stream's state.  A batch that runs again after a failure replaces its own partition and
no other (Spark puts the new files in place when the job commits), so that replays change nothing.  Readers
take each group from the last batch that changed it; they can stop at a batch, to see the totals as of then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: The column with a batch's number.
BATCH = "_batch"


def write_partials(groups: DataFrame, out: str, checkpoint: str, written: Callable[[int], None] = lambda _: None) -> None:
    """Runs the streaming aggregate ``groups`` over all that has arrived; ``written`` is called after each batch.

    Takes up where the checkpoint ends.  Groups keep apart by their keys; rows that arrive later than others of
    their group count as any.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(BATCH, F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(out)
        written(number)

    stream = groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.foreachBatch(keep).start().awaitTermination()


def _rows(spark: SparkSession, out: str, schema: StructType, base: str | None) -> DataFrame:
    """Groups with the number of the batch that they are of; of batches that ``base`` holds, from there alone."""
    whole = StructType([*schema.fields, StructField(BATCH, LongType())])
    try:
        rows = spark.read.schema(whole).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], whole)
    if base is None:
        return rows
    held = spark.read.schema(whole).parquet(base)
    last = held.agg(F.max(BATCH).alias("last")).first()["last"]
    # a filter on the partitions, so that their files aren't opened
    return held.unionByName(rows.where(F.col(BATCH) > (-1 if last is None else last)))


def _last(rows: DataFrame, schema: StructType, keys: list[str]) -> DataFrame:
    measures = [f.name for f in schema.fields if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*measures, BATCH), BATCH).alias("_last"))
    return last.select(*(c if c in keys else F.col(f"_last.{c}").alias(c) for c in schema.names), F.col(f"_last.{BATCH}").alias(BATCH))


def read_partials(spark: SparkSession, out: str, schema: StructType, keys: list[str], up_to: int | None = None, base: str | None = None) -> DataFrame:
    """The merged groups, as of batch ``up_to`` (else of all); none where no batch has written any.

    With ``base``, a table that ``compact`` wrote, only the batches behind it are read and merged with it, so
    that a read doesn't grow with the number of batches; ``up_to`` must not lie before the base.  A filter on
    the keys reaches the files.
    """
    rows = _rows(spark, out, schema, base)
    if up_to is not None:
        rows = rows.where(F.col(BATCH) <= up_to)
    return _last(rows, schema, keys).drop(BATCH)


def compact(spark: SparkSession, out: str, schema: StructType, keys: list[str], to: str, base: str | None = None) -> None:
    """Writes the merged groups of all batches so far to ``to``, a new base for reads; ``out`` stays as it is."""
    _last(_rows(spark, out, schema, base), schema, keys).write.parquet(to)

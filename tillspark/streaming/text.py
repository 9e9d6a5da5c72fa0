"""Raw text files as a stream: what arrives is cleaned and kept with its place.

Each arrival of files is a batch.  Its lines are cleaned and written to the partition of the batch's number, so
that a batch that runs again replaces its own rows.  A row's place (batch, file, line) orders rows over all
arrivals: where the last line of an id counts, later arrivals win, and within one, later files and lines.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaners import clean
from ..sources.files import ORDER, name_pattern
from ..sources.schemas import CLEANED
from .partials import BATCH

_PLACE = "struct<batch: long, file: string, block: long, line: long>"


def land(spark: SparkSession, folder: str, pattern: str, table: str, out: str, checkpoint: str, bad_rows: str = "fail", files_per_batch: int = 1000) -> None:
    """Takes the files in ``folder`` with ``pattern`` in their name that have arrived since the last call.

    The first line of a file is its header.  With ``bad_rows`` "fail" a line with too few fields stops the stream
    before its batch is written, and the next call meets the batch again.
    """
    reader = spark.readStream.schema("value string").option("header", True).option("sep", "\x01").option("quote", "")
    lines = reader.option("pathGlobFilter", name_pattern(pattern)).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def keep(batch: DataFrame, number: int) -> None:
        place = F.struct(F.lit(number).cast("long").alias("batch"), F.col("_file").alias("file"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("line"))
        rows = clean(batch.select("value", place.alias(ORDER)), table, bad_rows).withColumn(BATCH, F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(out)

    query = lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


def landed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The cleaned rows of ``table`` that have landed in ``out``, with their place; none before the first."""
    schema = f"{CLEANED[table]}, {ORDER} {_PLACE}"
    try:
        rows = spark.read.schema(f"{schema}, {BATCH} long").parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.drop(BATCH)

"""Loading of text files in which a file counts as a whole: one bad line rejects its file, and no other.

The lines are read once and written with their file and place to the shared folder; which files are good, and
where a bad one fails, comes from that table, so that nothing is parsed twice and no run ends for a bad line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaners import COLUMNS
from ..shared import fresh_path
from .files import ORDER, name_pattern
from .schemas import LEAST_FIELDS

#: Up to so many files' paths are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 100_000


@dataclass(frozen=True)
class Ingested:
    """``good``: cleaned rows of good files, with their place.  ``rejects``: file, n_lines and n_bad of each
    bad file, with its first bad line and the reason.  ``files``: all of them with n_lines and n_bad."""

    good: DataFrame
    rejects: DataFrame
    files: DataFrame


def placed_lines(lines: DataFrame) -> DataFrame:
    """value, file, and the place of each line (block of the file, then its number in the block) of lines that
    are read as whole text; they lose the carriage return at their end."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), place.alias("place"))


def _few(files: DataFrame) -> DataFrame:
    return F.broadcast(files) if files.count() <= BROADCAST_FILES else files


def ingest(spark: SparkSession, folder: str, pattern: str, table: str) -> Ingested:
    """The files in ``folder`` whose name contains ``pattern``, as ``table``; each file's first line is its header.

    A line is bad if it has fewer fields than its table, an empty one too.  A folder without such a file is an
    error; a file without lines, or with a header alone, is good and gives no rows.
    """
    lines = spark.read.option("pathGlobFilter", name_pattern(pattern)).option("lineSep", "\n").text(folder)
    if not lines.inputFiles():
        raise FileNotFoundError(f"no file in {folder} has {pattern} in its name")
    least = LEAST_FIELDS[table]
    fields = placed_lines(lines).withColumn("_f", F.split("value", ",", -1))
    bad = F.size("_f") < least
    # a bad line is kept as it is, a good one as its columns
    columns = COLUMNS[table](lambda i: F.get("_f", F.lit(i)))
    path = fresh_path(spark, "ingested")
    fields.select("file", "place", bad.alias("bad"), F.when(bad, F.col("value")).alias("line"), F.size("_f").alias("n_fields"), *columns).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    heads = rows.groupBy("file").agg(F.min("place").alias("head"), F.count("*").alias("n"), F.count_if("bad").alias("n_all_bad"), F.min_by("bad", "place").alias("head_bad"))
    files = heads.select("file", "head", (F.col("n") - 1).alias("n_lines"), (F.col("n_all_bad") - F.col("head_bad").cast("long")).alias("n_bad"))
    known = fresh_path(spark, "files")
    files.write.parquet(known)
    files = spark.read.parquet(known)
    good_files = files.where("n_bad = 0").select("file", "head")
    names = [c for c in rows.columns if c not in ("file", "place", "bad", "line", "n_fields")]
    good = rows.where("NOT bad").join(_few(good_files), "file").where("place > head").select(*names, F.struct("file", "place.block", "place.line").alias(ORDER))
    failed = rows.where("bad").join(_few(files.where("n_bad > 0")), "file").where("place > head")
    first = failed.groupBy("file", "n_lines", "n_bad").agg(F.min_by(F.struct("line", "n_fields"), "place").alias("x"))
    reason = F.concat(F.lit(f"{table}: under {least} fields: "), F.col("x.n_fields").cast("string"))
    return Ingested(good, first.select("file", "n_lines", "n_bad", "x.line", reason.alias("reason")), files.select("file", "n_lines", "n_bad"))

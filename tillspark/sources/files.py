"""Scans: folders of text files with a header, and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES


def selected_tables(names: str) -> list[str]:
    """A comma-separated selection of tables, in its order."""
    found = [n.strip() for n in names.split(",") if n.strip()]
    if unknown := [n for n in found if n not in TABLES]:
        raise ValueError(f"unknown tables: {', '.join(unknown)}")
    return found


#: Characters with a meaning in a path pattern.
_SPECIAL = re.compile(r"([\\*?\[\]{},])")
#: The column with a line's place among those of its table.
ORDER = "_order"


def name_pattern(part: str) -> str:
    """The glob of file names that contain ``part``."""
    return f"*{_SPECIAL.sub(r'\\\1', part)}*"


def scan_lines(spark: SparkSession, folder: str, pattern: str, blank: bool = False, order: bool = False) -> DataFrame:
    """Lines (value) of every file in ``folder`` whose name contains ``pattern``, without the header lines.

    The fields stay one string: lines have no quoting, and may be longer than their table.  A folder without
    such a file is an error.  ``blank`` adds the lines that hold nothing (a second scan, as the first leaves
    them out), so that cleaning can fail on them; ``order`` adds each line's place, by file and line.
    """
    glob = name_pattern(pattern)
    reader = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("pathGlobFilter", glob)
    lines = reader.csv(folder)
    if not lines.inputFiles():
        raise FileNotFoundError(f"no file in {folder} has {pattern} in its name")
    if order:
        # ids rise within a part of a file
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
        lines = lines.select("value", place.alias(ORDER))
    if blank:
        empty = spark.read.option("pathGlobFilter", glob).text(folder).where(F.trim("value") == "")
        lines = lines.unionByName(empty, allowMissingColumns=True)
    return lines


def scan_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the Parquet files of a table, with the schema that they have now.

    The path is a pattern, as a stream takes a single file only so.
    """
    return spark.readStream.schema(scan_parquet(spark, folder, name).schema).parquet(f"{folder}/{name}[.]parquet")

"""A result as one text file, all of it or nothing.

Tasks write parts beside the file, in the order of the result's partitions; when all of them are done, the parts
are joined a piece at a time into a file that then takes the result's place.  A job that fails leaves the old
file, or none.  Lines are parted by line feeds, with none at the end.

The folder has to be one that all machines mount, as tasks and the driver open its files.  A result without a
bound belongs in a folder of parts (``sinks.write_lines``): one file is joined by one machine.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "tillspark_result"
_PIECE = 1 << 20


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str
    lines: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.parts)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        # an attempt that runs twice writes another part; only the one that commits is joined
        path = f"{self.parts}/{context.partitionId()}-{context.taskAttemptId()}"
        n = 0
        with open(path, "w", encoding="utf-8", newline="") as out:
            for row in iterator:
                out.write(("\n" if n else "") + (row[0] or ""))
                n += 1
        return _Part(context.partitionId(), path, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        whole = f"{self.parts}/whole"
        with open(whole, "wb") as out:
            first = True
            for part in sorted((m for m in messages if m and m.lines), key=lambda m: m.partition):
                out.write(b"" if first else b"\n")
                first = False
                with open(part.path, "rb") as piece:
                    shutil.copyfileobj(piece, out, _PIECE)
        os.replace(whole, self.path)
        shutil.rmtree(self.parts)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class ResultFile(DataSource):
    """Takes one column of lines; option ``path`` is the file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_file(lines: DataFrame, path: str) -> None:
    """Replaces the file at ``path`` by the lines (first column), in the order of their partitions."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(ResultFile)
    lines.select(lines.columns[0]).write.format(FORMAT).mode("append").option("path", path).save()

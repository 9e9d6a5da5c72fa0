"""Rows of all tables as tagged JSON messages on one stream of text, and their way back.

A message has a table's name, a client and either a row's columns or the mark that the client's table ended.
Coming back, each is parsed once into a variant; one pass writes all of them by table (what is no message of a
known table goes apart), and a table is read from its own part with the types that it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import CLEANED

#: Where messages go that are none of a known table.
UNKNOWN = "unknown"


def _types(table: str) -> StructType:
    return StructType.fromDDL(CLEANED[table])


def encode(tables: dict[str, DataFrame], client: Column) -> DataFrame:
    """One message (value) per row of the cleaned ``tables`` (by name)."""
    out = None
    for name, df in tables.items():
        payload = F.struct(*(F.col(f.name) for f in _types(name).fields))
        rows = df.select(F.to_json(F.struct(F.lit(name).alias("type"), client.alias("client"), payload.alias("payload"), F.lit(False).alias("end"))).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def end_of(spark: SparkSession, tables: list[str], client: str) -> DataFrame:
    """The messages that end each of ``tables`` for a client."""
    rows = spark.createDataFrame([(t, client) for t in tables], "type string, client string")
    return rows.select(F.to_json(F.struct("type", "client", F.lit(True).alias("end"))).alias("value"))


def parts(messages: DataFrame) -> DataFrame:
    """type (the part), client, end, payload and, of what is unknown, value; a message's variant is walked once."""
    parsed = messages.select("value", F.try_parse_json("value").alias("v"))
    heads = parsed.select("value", F.try_variant_get("v", "$", "struct<type: string, client: string, end: boolean, payload: variant>").alias("head"))
    kind, end, payload = F.col("head.type"), F.coalesce("head.end", F.lit(False)), F.col("head.payload")
    # an object gives a struct without fields, whatever it holds; anything else gives null
    is_object = F.try_variant_get(payload, "$", "struct<>").isNotNull()
    table = F.when(kind.isin(*CLEANED) & (end | is_object), kind).otherwise(UNKNOWN)
    rows = heads.select(table.alias("type"), F.col("head.client").alias("client"), end.alias("end"), payload.alias("payload"), "value")
    return rows.select("type", "client", "end", "payload", F.when(F.col("type") == UNKNOWN, F.col("value")).alias("value"))


def route(messages: DataFrame, path: str) -> None:
    """Writes ``messages`` (value) to a part for each table, in one pass without a shuffle.

    What isn't JSON, has no known type or isn't ended or filled goes to the part ``unknown`` as it is.
    """
    parts(messages).write.mode("overwrite").partitionBy("type").parquet(path)


def _part(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema("client string, end boolean, payload variant, value string, type string").parquet(path).where(F.col("type") == table)


def _typed(name: str, kind: str) -> Column:
    # texts that stand for times and odd numbers are cast by the rules of text
    field = F.try_variant_get("payload", f"$.{name}", "string")
    return field if kind == "string" else field.try_cast(kind)


def routed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """client and the cleaned columns of one table; a field that doesn't have its type is null."""
    rows = _part(spark, path, table).where("NOT end")
    return rows.select("client", *(_typed(f.name, f.dataType.simpleString()).alias(f.name) for f in _types(table).fields))


def ended(spark: SparkSession, path: str) -> DataFrame:
    """client and type of the tables that ended."""
    return spark.read.schema("client string, end boolean, type string").parquet(path).where("end").select("client", "type").distinct()


def unknown(spark: SparkSession, path: str) -> DataFrame:
    return _part(spark, path, UNKNOWN).select("value")

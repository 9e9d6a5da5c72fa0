"""Operator 5: exact deduplication as a stateful stream.

``arrivals`` adds rows to a landing table: digest, stable id, length, a content locator (number of the arrival,
and of the row in it) and the text that it locates.  ``exact_groups`` streams the digests through keyed state
that RocksDB keeps on disk, without watermark or expiry: the state of a digest is the best row so far and the
number of rows.  Every hit is then checked on full bytes: the normalised texts of a digest, which its locators
lead to, must be one text, else its rows are grouped anew by the texts themselves.  With a ``state`` folder,
later arrivals meet what is there.

Cases: a null or empty text, or one of white space alone, is the empty text; of rows with equal texts, length
and id the one that arrived first stays; null ids lose against others, and of null ids alone the first row
stays (its keep_id is null); a text of any length is hashed and compared whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, fresh_path, staged

#: The characters that make no difference, `[\\x20\\x09-\\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
#: State on disk; without fallocate, which would reserve megabytes for each of many small stores, and with one
#: bound on the memory of all stores of an executor, as each partition has its own.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text: Column, bits: int = 256) -> Column:
    """SHA-256 of the normalised text as lowercase hex; fewer ``bits`` make collisions (for tests)."""
    return F.substring(F.sha2(normalised(text), 256), 1, bits // 4)


def arrivals(docs: DataFrame, path: str, bits: int = 256, arrival: int | None = None) -> DataFrame:
    """The landing table at ``path`` with the rows of ``docs`` added: digest, doc_id, n_cp (code points of the
    text), row (with arrival, the content locator), text and arrival.

    An arrival lands in a partition of its number, the next one by default, and is noted once it is there whole.
    A call that was cut off before that is replaced; the stream hasn't read its rows.  A caller that may repeat
    a call gives its arrivals numbers: one that is noted isn't added again.
    """
    spark = docs.sparkSession
    n_cp = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp")
    rows = docs.select(digest(F.col("text"), bits).alias("digest"), "doc_id", n_cp, F.monotonically_increasing_id().alias("row"), "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("arrival", T.IntegerType())])
    notes = f"{path}-arrivals"
    noted = {r["arrival"] for r in _found(spark, "arrival int", notes).collect()}
    number = max(noted, default=-1) + 1 if arrival is None else arrival
    if number not in noted:
        numbered = rows.withColumn("arrival", F.lit(number).cast("int"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("arrival").parquet(path)
        spark.createDataFrame([(number,)], "arrival int").coalesce(1).write.mode("append").parquet(notes)
    return spark.read.schema(schema).parquet(path)


def _found(spark: SparkSession, schema: str | T.StructType, path: str) -> DataFrame:
    """The table at ``path``, or one without rows if nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def best() -> Column:
    """The row that stays of those with one text."""
    return F.max(F.struct("n_cp", (-F.col("doc_id")).alias("id"), (-F.col("arrival")).alias("arrival"), (-F.col("row")).alias("row"))).alias("best")


BEST = "struct<n_cp: long, id: long, arrival: int, row: long>"


def exact_groups(landing: DataFrame, path: str, files_per_batch: int = 1000, state: str | None = None) -> DataFrame:
    """digest, best and group_size of every digest in the landing table (Parquet at ``path``).

    The stream goes on from its checkpoint in the folder ``state``, where one is given, and a batch that runs
    twice overwrites its own output.  It runs in a session of its own, as the state store is a setting.
    """
    spark = landing.sparkSession
    state = state or fresh_path(spark, "stream")
    session = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if session.conf.isModifiable(k):
            session.conf.set(k, v)
    # not asked whether these are modifiable: the store's own settings are no registered ones
    for k, v in STATE.items():
        session.conf.set(k, v)
    stream = session.readStream.schema(landing.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).drop("text")
    groups = stream.groupBy("digest").agg(best(), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/groups/batch={number}")

    query = groups.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{state}/checkpoint").foreachBatch(keep).start()
    query.awaitTermination()
    found = _found(spark, f"digest string, best {BEST}, group_size long, batch int", f"{state}/groups")
    # each batch updates the digests it met; the size only grows
    return found.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s")).select("digest", "s.best", "s.group_size")


def exact_dedup(docs: DataFrame, bits: int = 256, state: str | None = None, arrival: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``state``: a shared folder that keeps landing table and state; the result then covers all that arrived
    there so far.  With the number of the ``arrival``, a call that is repeated after a failure counts no row
    twice.
    """
    state = state or fresh_path(docs.sparkSession, "arrivals")
    path = f"{state}/landing"
    landing = arrivals(docs, path, bits, arrival)
    groups = staged(exact_groups(landing, path, state=state), "groups")
    hits = groups.where("group_size > 1").select("digest")
    if hits.count() <= BROADCAST_IDS // 4:  # a digest is as long as some ids
        hits = F.broadcast(hits)
    whole = normalised(F.col("text"))
    texts = landing.join(hits, "digest")
    unequal = texts.groupBy("digest").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).where("a != b").select("digest")
    unequal = staged(unequal, "unequal")
    stays = ((-F.col("arrival")).eqNullSafe(F.col("best.arrival")) & (-F.col("row")).eqNullSafe(F.col("best.row"))).alias("kept")
    sha = F.col("digest") if bits == 256 else digest(F.col("text"))
    rows = landing.join(groups, "digest").select("digest", "doc_id", (-F.col("best.id")).alias("keep_id"), "group_size", stays, sha.alias("text_sha256"))
    if unequal.isEmpty():
        return rows.drop("digest")
    # digests that are met by different texts
    odd = landing.join(unequal, "digest").withColumn("text", whole)
    own = odd.groupBy("digest", "text").agg(best(), F.count("*").alias("group_size"))
    regrouped = odd.join(own, ["digest", "text"]).select("doc_id", (-F.col("best.id")).alias("keep_id"), "group_size", stays, F.sha2("text", 256).alias("text_sha256"))
    return rows.join(unequal, "digest", "left_anti").drop("digest").unionByName(regrouped)

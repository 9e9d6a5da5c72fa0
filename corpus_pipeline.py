"""The corpus pipeline: quality rules, exact, near and substring deduplication, then packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``.  ``run`` writes each stage's rows and reads them again for the next.  Document
ids are unique; rows that share an id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import exact, near, packing, quality, suffix
from tillspark.llm.common import by_id, fresh_path, staged, table
from tillspark.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, decisions: DataFrame, name: str) -> DataFrame:
    """``docs`` without the ids that no row of ``decisions`` keeps."""
    dropped = decisions.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return by_id(docs.select(*COLUMNS), staged(dropped, name), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, quality.quality_rules(docs).select("doc_id", "kept"), "rejected")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, exact.exact_dedup(docs).select("doc_id", "kept"), "copies")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, near.near_duplicates(docs).select("doc_id", "kept"), "near-copies")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(docs, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json"), 2048))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Outlier estimates, tokens and packing are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Operator 6: token-id files under canonical length-limited Huffman codes.

``write`` encodes whole texts, appends an end id to each, counts all ids, makes one code for the corpus and
writes three Parquet tables below a path:

* ``codebook``: one row, the code length of every id (0: unused) and the coding limits;
* ``segments``: in ascending document order, rows of some millions of ids: the documents' ids and lengths,
  a bit stream, and the bit offset at which each block of ``BLOCK`` ids begins (the checkpoints, by which a
  reader enters the stream at any block);
* ``parts``: the number of ids in each part of the order, from which every document's start follows.

``read`` decodes with one table lookup per id, all blocks of a segment side by side.

Cases: a null or empty text is the end id alone; repeated rows are kept; null ids come first; an empty
table gives files without segments; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged
from .packing import encoder

#: Longest code in bits, unless there are more ids than such codes; the decoding table has two to that power entries.
LIMIT = 16
#: Ids of a block, the unit that is decoded alone.
BLOCK = 512
#: Ids from which a segment is closed; a longer document still stays whole.
SEGMENT_IDS = 1_500_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with a count (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n = len(leaves)
    row, rows = leaves, []
    for _ in range(limit - 1):
        rows.append(row)
        even = row[: len(row) // 2 * 2]
        packages = even[0::2] + even[1::2]
        row = np.sort(np.concatenate([leaves, packages]), kind="stable")
    rows.append(row)
    taken, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for k in range(len(rows) - 1, -1, -1):
        # of equal weights a leaf goes first; those taken are the lightest
        if not k:
            own = taken
        else:
            even = rows[k - 1][: len(rows[k - 1]) // 2 * 2]
            packages = even[0::2] + even[1::2]
            places = np.searchsorted(packages, leaves, "left") + np.arange(n)
            own = int(np.searchsorted(places, taken, "left"))
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in canonical order: by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        sizes = lengths[order].astype(np.int64)
        step = 1 << (int(sizes[-1]) - sizes)
        codes[order] = (np.concatenate([[0], np.cumsum(step)[:-1]]) >> (int(sizes[-1]) - sizes)).astype(np.uint32)
    return codes


def put_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids``, and the bit offset of each block of ids."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    if not len(ids):
        return b"", starts
    word, at = starts >> 5, starts & 31
    wide = codes[ids].astype(np.uint64) << (64 - at - size).astype(np.uint64)
    words = np.zeros(int(ends[-1] + 31 >> 5) + 1, np.uint32)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat((wide >> np.uint64(32)).astype(np.uint32), first)
    over = np.flatnonzero(at + size > 32)
    words[word[over] + 1] |= (wide[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::block]


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every ``limit`` bits that a stream can show."""
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    size = lengths[used].astype(np.int64)
    order = np.argsort((codes[used].astype(np.int64) << (limit - size)), kind="stable")
    span = 1 << (limit - size[order])
    ids, sizes = np.repeat(used[order], span), np.repeat(size[order], span)
    rest = (1 << limit) - len(ids)
    return np.concatenate([ids, np.zeros(rest, np.int64)]).astype(np.uint32), np.concatenate([sizes, np.ones(rest, np.int64)])


def get_bits(stream: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK, limit: int = LIMIT) -> np.ndarray:
    """The ``n`` ids of a stream, from the bit offsets of its blocks."""
    raw = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.uint32)
    seen = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    ids, sizes = table
    out = np.zeros((block, len(offsets)), np.uint32)
    at, mask = offsets.astype(np.int64).copy(), np.uint32((1 << limit) - 1)
    whole = n // block
    for k in range(block):
        if k == n - whole * block:
            at = at[:whole]  # the last block is shorter
        shown = seen[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32) & mask
        out[k, : len(at)] = ids[shown]
        at += sizes[shown]
    return out.T.reshape(-1)[:n]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, byte_level: bool = True) -> None:
    """Encodes ``docs`` (doc_id, text) into the files described above."""
    spark = docs.sparkSession

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, and one per task with the counts of its ids."""
        enc, end = encoder(tokenizer, byte_level), np.array([end_id], "<u4")
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        total = np.zeros(0, np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        for batch in batches:
            coded = [np.concatenate([ids, end]).astype(kind) for ids in enc.texts(batch.column(1))]
            found = np.bincount(np.concatenate(coded), minlength=len(total))
            found[: len(total)] += total
            total = found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, coded), pa.int64()), pa.array([x.tobytes() for x in coded], pa.binary()), pa.nulls(len(coded), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                total = np.frombuffer(x.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["id", "n"])

    coded = staged(docs.select("doc_id", "text").mapInArrow(tokenise, "doc_id long, n_tokens long, ids binary, counts binary"), "ids")
    # as many rows as the vocabulary has ids
    counted = coded.where("counts IS NOT NULL").select("counts").mapInArrow(unfold, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    coded = coded.where("counts IS NULL").drop("counts")
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    # a vocabulary of more ids than codes of LIMIT bits takes longer ones
    limit = max(LIMIT, (int(np.count_nonzero(counts)) - 1).bit_length())
    lengths = code_lengths(counts, limit)
    codes = canonical(lengths)
    spark.createDataFrame([(limit, BLOCK, bytearray(lengths.tobytes()))], "code_limit int, block int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            stream, offsets = put_bits(np.concatenate([x for _, x in held]), codes, lengths)
            row = {
                "part": part, "segment": number, "n_tokens": sum(len(x) for _, x in held),
                "doc_ids": [d for d, _ in held], "doc_tokens": [len(x) for _, x in held],
                "checkpoints": offsets.astype("<u8").tobytes(), "stream": stream,
            }
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], SEGMENT)

        size = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(2), batch.column(1)), strict=True):
                held.append((doc, ids))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield close()
                    size = 0
        if held:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(segment, SEGMENT_DDL).write.option("compression", "none").parquet(f"{path}/segments")
    sums = spark.read.parquet(f"{path}/segments").groupBy("part", "segment").agg(F.sum("n_tokens").alias("n_tokens"))
    # starts within each part, and those of the parts: as many rows as the range exchange has partitions
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = sums.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts.select("part", "segment", (F.col("base") + F.col("inside")).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


SEGMENT_DDL = "part int, segment int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, stream binary"
SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("stream", pa.binary())])


def ids_of(ids: pa.Array, n_tokens: pa.Array) -> Iterator[np.ndarray]:
    for x, n in zip(ids, n_tokens.to_pylist(), strict=True):
        raw = x.as_buffer()
        yield np.frombuffer(raw, f"<u{raw.size // n}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document of the files."""
    row = spark.read.parquet(f"{path}/codebook").first()
    limit, block, lengths = row["code_limit"], row["block"], np.frombuffer(bytes(row["lengths"]), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths, limit)
        for batch in batches:
            for row in batch.to_pylist():
                ids = get_bits(row["stream"], np.frombuffer(row["checkpoints"], "<u8"), row["n_tokens"], table, block, limit).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                values = pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(ends - starts), values], ["doc_id", "start", "n_tokens", "ids"])

    found = spark.read.parquet(f"{path}/segments").join(spark.read.parquet(f"{path}/parts"), ["part", "segment"])
    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

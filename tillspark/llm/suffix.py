"""Operator 2: removal of long repeated substrings, by a run-length suffix index.

A byte goes if it is covered by a ``length``-byte string that also starts earlier: in a document with a
smaller id, or further left in its own.  Matches stay within documents; all is judged on the input.

1. Anchors.  Every ``length``-byte string belongs to the leftmost minimum among the hashes of its
   substrings of ``gram(length)`` bytes, so equal strings meet at equal anchors.  The strings of one anchor
   follow each other; together they are its context.
2. Contexts meet by the anchor's hash.  Of equal contexts (equal 128-bit BLAKE2b digests) all but the first
   are repeats throughout (those within a task's slice never meet others).  Anchors with several different
   contexts go on, one representative of each context.
3. Representatives of an anchor are indexed together (see ``rindex``): the task streams their contexts
   through the index, and marks strings whose match of ``length`` bytes lies in an interval of the
   transform whose first occurrence is elsewhere and earlier.
4. An anchor of more than ``GROUP_CONTEXTS`` contexts is dealt out to parts of about that size, each indexed
   on its own.  A part marks all but the first of its equal strings, and gives the bytes of those it didn't
   mark; of equal ones among these (one a part at most) all but the first are marked too.

Cases: a null or empty text has no bytes and stays; rows that repeat an id are one document (equal places
are no repeats of each other); rows with a null id are left as they are; a text of any length is taken
whole, and a run of one byte in it is cut to its first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, by_id, released, staged
from .hashing import flat, mix, powers, prefix_sums
from .rindex import RunIndex, equal_prefixes, suffix_order
from .tokens import slices

#: Bytes of contexts that a task indexes at once.
INDEX_BYTES = 1_000_000
#: Contexts of one anchor that are indexed together, about; more are dealt out to parts.
GROUP_CONTEXTS = 1_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (np.minimum, np.maximum) over each ``width`` values of ``x`` from a place on."""
    done = 1
    while done * 2 <= width:
        x = of(x[: len(x) - done], x[done:])
        done *= 2
    return of(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def gram(length: int) -> int:
    """Bytes of the substrings whose hashes make anchors: longer ones make fewer different contexts meet, but
    more anchors."""
    return 2 * length // 5


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit digests of spans of ``data``, two numbers each."""
    raw = data.tobytes()
    found = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Document number, first and last byte of the context, the anchor's hash and the context's digest, of every
    anchor in texts."""
    n, size = len(data), gram(length)
    window = length - size + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.reshape(0, 2)
    sums = prefix_sums(data)
    grams = mix((sums[size:] - sums[:-size]) * powers(n)[0][: n - size + 1])
    least = _sliding(grams, window, np.minimum)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[: len(least)] == doc[length - 1 :]
    # an anchor's strings end where the minimum changes, or leaves on the left, or the document ends
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    last = stop + length
    own = doc[first]
    return own, first - offsets[own], last - offsets[own], least[first], digests(data, first, last)


ROWS = ["hash", "context", "digest", "doc_id", "first", "last", "repeat"]
ROWS_DDL = "hash long, context long, digest long, doc_id long, first long, last long, repeat boolean"
FOUND = ["hash", "doc_id", "first", "last", "marked"]
FOUND_DDL = "hash long, doc_id long, first long, last long, marked boolean"


def _anchor_rows(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base = 0
        for part in slices(batch.column(1), 2_000_000):
            ids = batch.column(0).slice(base, len(part)).to_numpy(zero_copy_only=False)
            base += len(part)
            doc, first, last, anchor, context = anchors(*flat(part), length)
            doc_id = ids[doc].astype(np.int64)
            order = np.lexsort((first, doc_id, context[:, 1], context[:, 0], anchor))
            g, c = anchor[order], context[order]
            # all but the first of equal contexts in this slice are repeats, unless they are the same place
            fresh = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(c, axis=0) != 0).any(axis=1)])[: len(order)]
            lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
            again = (doc_id[order] != doc_id[lead]) | (first[order] != first[lead])
            keep = fresh | again
            o = order[keep]
            columns = [anchor[o].view(np.int64), context[o, 0], context[o, 1], doc_id[o], first[o], last[o], ~fresh[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ROWS)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats, and representatives of anchors with several contexts, from rows in order of ROWS."""
    held: list[np.ndarray] | None = None
    out = False  # whether the held representative has gone out

    def batch_of(rows: list[np.ndarray], marked: bool) -> pa.RecordBatch:
        columns = [rows[0], *rows[3:6], np.full(len(rows[0]), marked)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], FOUND)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        repeat = rows[6].astype(bool)
        yield batch_of([x[repeat] for x in rows[:6]], True)
        rows = [x[~repeat] for x in rows[:6]]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        n = len(rows[0])
        if not n:
            continue
        new_hash = np.concatenate([[True], np.diff(rows[0]) != 0])
        new = new_hash | np.concatenate([[True], (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)])
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        later = ~new & ((rows[3] != rows[3][lead]) | (rows[4] != rows[4][lead]))
        yield batch_of([x[later] for x in rows], True)
        # representatives whose anchor has another one before or behind them
        reps = np.flatnonzero(new)
        group = np.cumsum(new_hash[reps])
        several = np.bincount(group)[group] > 1
        several[0] |= out
        send = several.copy()
        if held is not None and out:
            send[0] = False
        yield batch_of([x[reps[send]] for x in rows], False)
        # the last one is held: the next batch may bring its anchor's next context
        out = bool(several[-1])
        held = [x[reps[-1] : reps[-1] + 1] for x in rows]


def _index_marks(texts: list[bytes], locations: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the places of its ``length``-byte strings that occur earlier.

    ``locations``: a number per context by which its first byte is ordered among all documents' bytes; one
    byte further is one more.
    """
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).copy()
    ends = np.cumsum(sizes + 1) - 1
    text += 1  # UTF-8 has no byte 255
    text[ends] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inner = np.arange(len(text)) - (ends - sizes)[owner]
    order, ranks = suffix_order(text, length)
    head = ~equal_prefixes(order, ranks, length)
    location = locations[owner] + inner
    whole = inner + length <= sizes[owner]
    starts = np.flatnonzero(head)
    # the first occurrence in each interval of rows with the same string
    least = np.minimum.reduceat(np.where(whole, location, np.iinfo(np.int64).max)[order], starts)
    index = RunIndex(text, order)
    del ranks, order
    width = int(sizes.max())
    patterns = np.zeros((len(texts), width), np.uint8)
    column = np.arange(len(text)) + width - sizes[owner] - (ends - sizes)[owner]
    real = text > 0
    patterns[owner[real], column[real]] = text[real]
    found = np.zeros((len(texts), width), bool)
    for place, row, size in index.statistics(patterns, sizes):
        k = np.flatnonzero((size >= length) & (sizes >= width - place))
        interval = np.searchsorted(starts, row[k], "right") - 1
        found[k, place] = least[interval] < locations[k] + place - (width - sizes[k])
    return [np.flatnonzero(found[k, width - s :]) for k, s in enumerate(sizes.tolist())]


MARKS = ["doc_id", "first", "last", "string"]
MARKS_DDL = "doc_id long, first long, last long, string binary"


def _mark_groups(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from rows (hash, part, parts, doc_id, first, bytes) that come in order of hash and part.

    A row with a ``string`` is no mark: it is a string of one of several parts of an anchor, not marked yet.
    """
    rows: list[tuple[int, int, int, int, int, bytes]] = []

    def batch_of(docs: np.ndarray, first: np.ndarray, last: np.ndarray, strings: list[bytes] | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(first), pa.array(last), pa.array(strings or [None] * len(docs), pa.binary())], MARKS)

    def close(group: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        group = sorted(group, key=lambda r: r[3:5])
        docs = np.array([r[3] for r in group], np.int64)
        firsts = np.array([r[4] for r in group], np.int64)
        number = np.unique(docs, return_inverse=True)[1]
        places = _index_marks([r[5] for r in group], (number.astype(np.int64) << 40) + firsts, length)
        owner = np.repeat(np.arange(len(group)), [len(p) for p in places])
        at = firsts[owner] + np.concatenate(places)
        # strings that follow each other make one span
        new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(at) != 1)])[: len(at)]
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(at)]])[: len(begin)] - 1
        yield batch_of(docs[owner[begin]], at[begin], at[end] + length)
        for k, (_, _, parts, _, _, raw) in enumerate(group):
            if parts > 1:
                left = np.setdiff1d(np.arange(len(raw) - length + 1), places[k], assume_unique=True)
                yield batch_of(np.full(len(left), docs[k]), firsts[k] + left, firsts[k] + left + length, [raw[x : x + length] for x in left.tolist()])

    held, last = 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held >= INDEX_BYTES and row[:2] != last:
                yield from close(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[5])
            last = row[:2]
    if rows:
        yield from close(rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            out += [(w["hash"], doc_id, w["first"], raw[w["first"] : w["last"]]) for w in wanted]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["hash", "doc_id", "first", "bytes"])


def repeats(docs: DataFrame, length: int = 100, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """doc_id and spans (array of first, last in bytes, unmerged) of the documents with repeated strings."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    rows = docs.mapInArrow(released(partial(_anchor_rows, length)), ROWS_DDL)
    order = ["hash", "context", "digest", "doc_id", "first"]
    # what is known to be a repeat needn't meet anything: it is dealt out evenly
    place = F.when(F.col("repeat"), F.xxhash64("doc_id", "first")).otherwise(F.col("hash"))
    found = staged(rows.repartition(n, place).sortWithinPartitions(*order).mapInArrow(released(_resolve), FOUND_DDL), "found")
    reps = found.where("NOT marked").drop("marked")
    ids = staged(reps.select("doc_id").distinct(), "ids")
    wanted = reps.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "first", "last")).alias("wanted"))
    contexts = staged(by_id(docs, ids).join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(released(_contexts), "hash long, doc_id long, first long, bytes binary"), "contexts")
    hot = staged(reps.groupBy("hash").count().where(F.col("count") > group_contexts).select("hash", F.ceil(F.col("count") / group_contexts).alias("parts")), "hot")
    n_hot = hot.count()
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = contexts.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot, "hash", "left").select("hash", F.pmod(F.xxhash64("doc_id", "first"), parts).alias("part"), parts.alias("parts"), "doc_id", "first", "bytes")
    grouped = dealt.repartition(n, "hash", "part").sortWithinPartitions("hash", "part", "doc_id", "first")
    marks = grouped.mapInArrow(released(partial(_mark_groups, length)), MARKS_DDL)
    columns = ["doc_id", "first", "last"]
    spans = found.where("marked").select(*columns)
    if n_hot:
        marks = staged(marks, "marks")
        strings = marks.where("string IS NOT NULL")
        least = strings.groupBy("string").agg(F.min(F.struct("doc_id", "first")).alias("least"))
        later = strings.join(least, "string").where(F.struct("doc_id", "first") > F.col("least"))
        spans = spans.unionByName(later.select(*columns))
    spans = spans.unionByName(marks.where("string IS NULL").select(*columns))
    return staged(spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Disjoint maximal spans, ascending."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            raw, gone = text.encode(), merged(spans)
            bounds = [0, *(x for s in gone for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            flat_spans = [{"first": a, "last": b} for a, b in gone]
            out.append((doc_id, len(raw), sum(b - a for a, b in gone), flat_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept_text"]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, batch.column(3)], [*names, "carried"])


CUT_DDL = "doc_id long, n_bytes long, n_removed long, spans array<struct<first: long, last: long>>, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, length: int = 100, group_contexts: int = GROUP_CONTEXTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs), kept_sha256, kept_text (what is left of a
    character that was cut is dropped from it) and the columns in ``carry`` of every row of ``docs``."""
    spans = repeats(docs, length, group_contexts)
    carried = F.struct(*carry) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), carried.alias("carried"))
    ids = spans.select("doc_id")
    schema = T.StructType.fromDDL(CUT_DDL).add("carried", texts.schema["carried"].dataType)
    cut = by_id(texts, ids).join(spans, "doc_id").select("doc_id", "text", "spans", "carried").mapInArrow(released(_cut), schema)
    rest = by_id(texts, ids, "left_anti").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<first: bigint, last: bigint>>").alias("spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.col("text").alias("kept_text"),
        "carried",
    )
    both = cut.unionByName(rest)
    return both.select(*(c for c in both.columns if c != "carried"), *(f"carried.{c}" for c in carry))

"""Operator 4: quality classifier, a factorisation machine.

A text's features are its hashed distinct words, statistics of its structure and its length, and metadata:
the number of characters that its row states, and whether it states any (language, source and id are never read).  The machine scores them with a weight each and a low-rank weight for every pair, in linear time
by the sum-of-squares identity: the pairs of a factor sum to half of (sum of v*x)**2 - sum of (v*x)**2.

It is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hashes of their ids, in one task
(some megabytes of features), and applied to every row.

Cases: a null or empty text is scored by its (zero) statistics; null labels aren't learned from; with no
labelled row every score is 0.5; a table without n_chars, or a null or unreadable one, states none; repeated
rows are scored alike, and so are ties; a text of any length is scored whole; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .hashing import BLANK, flat, lower, prefix_sums, span_hash, words
from .langid import held_out
from .tokens import slices

BITS, RANK = 16, 4
TRAIN_ROWS = 6000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-4
_KINDS = np.zeros((7, 256), bool)
_KINDS[0, 65:91] = True  # capitals
_KINDS[1, 48:58] = True
_KINDS[2, [ord(c) for c in ".,;:!?'\"()-"]] = True
_KINDS[3, [ord(c) for c in "#*$%&|<>@_=+~^{}[]\\/"]] = True
_KINDS[4, 128:] = True
_KINDS[5, [ord(c) for c in "!?"]] = True
_KINDS[6, 10] = True
STATS = 7 + 6 + 2


def features(texts: pa.Array, n_chars: pa.Array | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Statistics of each text, and the hashes (BITS bits) of its distinct words, A-Z lower-cased."""
    data, offsets = flat(texts)
    starts, ends, first = words(data, offsets)
    hashes = (span_hash(prefix_sums(lower(data)), starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    n = len(texts)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    n_words = np.diff(first)
    stats = np.zeros((n, STATS))
    stated = np.full(n, np.nan) if n_chars is None else n_chars.to_numpy(zero_copy_only=False).astype(float)
    stats[:, 13] = np.log1p(np.clip(np.nan_to_num(stated, nan=0.0, posinf=0.0), 0, None))
    stats[:, 14] = np.isnan(stated)
    for k, kind in enumerate(_KINDS):
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        stats[:, k] = np.sqrt((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
    letters = np.concatenate([[0], np.cumsum(~BLANK[data])])
    chars = letters[offsets[1:]] - letters[offsets[:-1]]
    stats[:, 7] = np.log1p(n_words)
    stats[:, 8] = np.log1p(chars / np.maximum(n_words, 1))
    distinct = []
    order = np.argsort(np.repeat(np.arange(n), n_words) << BITS | hashes, kind="stable")
    pair = (np.repeat(np.arange(n), n_words) << BITS | hashes)[order]
    kept = np.concatenate([[True], np.diff(pair) != 0])[: len(pair)]
    own = pair[kept]
    bounds = np.searchsorted(own, np.arange(n + 1) << BITS)
    distinct = [own[a:b] & ((1 << BITS) - 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    n_distinct = np.diff(bounds)
    stats[:, 9] = n_distinct / np.maximum(n_words, 1)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])[: len(hashes)]
    doc = np.repeat(np.arange(n), n_words)
    stats[:, 10] = np.bincount(doc[same], minlength=n) / np.maximum(n_words, 1)
    lines = np.maximum(stats[:, 6] ** 2 * size, 0) + 1
    stats[:, 11] = np.log1p(n_words / lines)
    stats[:, 12] = np.log1p(np.bincount(doc, weights=(ends - starts).astype(float) ** 2, minlength=n) / np.maximum(chars, 1))
    return stats, distinct


class Machine:
    """Weights w (per feature) and v (feature x RANK); the statistics' features follow the words'."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        self.mean, self.scale, n = mean, scale, (1 << BITS) + STATS
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, RANK))

    def rows(self, stats: np.ndarray, distinct: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all rows, and where each row's begin."""
        scaled = np.clip((stats - self.mean) / self.scale, -6, 6) / np.sqrt(STATS)
        sizes = np.array([len(d) for d in distinct])
        ends = np.cumsum(sizes + STATS)
        ids, x = np.empty(int(ends[-1]), np.int64), np.empty(int(ends[-1]))
        place = np.arange(int(ends[-1])) - np.repeat(ends - sizes - STATS, sizes + STATS)
        is_stat = place < STATS
        ids[is_stat], x[is_stat] = (1 << BITS) + np.tile(np.arange(STATS), len(sizes)), scaled.ravel()
        ids[~is_stat] = np.concatenate(distinct)
        x[~is_stat] = np.repeat(0.5 / np.sqrt(np.maximum(sizes, 1)), sizes)
        return ids, x, ends - sizes - STATS

    def scores(self, ids: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, first, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[ids] * x, first) + pairs, sums, vx

    def probability(self, stats: np.ndarray, distinct: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scores(*self.rows(stats, distinct))[0], -30, 30)))

    def fit(self, stats: np.ndarray, distinct: list[np.ndarray], y: np.ndarray) -> None:
        """Logistic loss by Adagrad over shuffled batches."""
        rng = np.random.default_rng(11)
        square_w, square_v, square_b = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rate_w = np.full(len(self.w), RATE)
        rate_w[1 << BITS :] = 10 * RATE
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                rows = order[at : at + BATCH]
                ids, x, first = self.rows(stats[rows], [distinct[r] for r in rows])
                score, sums, vx = self.scores(ids, x, first)
                error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]
                owner = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([first, [len(ids)]])))
                e = error[owner] / len(rows)
                used, slot = np.unique(ids, return_inverse=True)
                gw = np.bincount(slot, weights=e * x) + DECAY * self.w[used]
                pull = (e * x)[:, None] * (sums[owner] - vx)
                gv = np.stack([np.bincount(slot, weights=pull[:, f]) for f in range(RANK)], axis=1) + DECAY * self.v[used]
                gb = error.mean()
                square_w[used] += gw**2
                square_v[used] += gv**2
                square_b += gb**2
                self.w[used] -= rate_w[used] * gw / np.sqrt(square_w[used])
                self.v[used] -= RATE * gv / np.sqrt(square_v[used])
                self.bias -= RATE * gb / np.sqrt(square_b)


def _inputs(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("string").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), stated.alias("n_chars"))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in slices(batch.column(0), 2_000_000):
            stats, distinct = features(part, batch.column(1).slice(at, len(part)))
            rows = [x.tobytes() for x in stats], [x.astype("<u4").tobytes() for x in distinct]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in rows), batch.column(2).slice(at, len(part))], ["stats", "words", "y"])
            at += len(part)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stats, distinct, y = [], [], []
    for batch in batches:
        stats += [np.frombuffer(x) for x in batch.column(0).to_pylist()]
        distinct += [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
        y += batch.column(2).to_pylist()
    if y:
        # the same model in whatever order the rows come
        order = sorted(range(len(y)), key=lambda i: (stats[i].tobytes(), y[i]))
        table = np.array([stats[i] for i in order])
        machine = Machine(table.mean(axis=0), table.std(axis=0) + 1e-3)
        machine.fit(table, [distinct[i] for i in order], np.array([y[i] for i in order], float))
        parts = [machine.mean, machine.scale, np.array([machine.bias]), machine.w, machine.v.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).astype("<f8").tobytes()], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine | None:
    """The machine for ``labels`` (doc_id, label 0 or 1) of ``docs`` (doc_id, text)."""
    ids = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("double").alias("y"))
    chosen = ids.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    chosen = staged(chosen, "chosen")  # bounded by train_rows
    sample = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("text", "n_chars", "y")
    rows = staged(sample.mapInArrow(_sample, "stats binary, words binary, y double"), "sample")
    found = rows.coalesce(1).mapInArrow(_fit, "model binary").collect()
    if not found:
        return None
    flat_model = np.frombuffer(bytes(found[0]["model"]), "<f8")
    n = (1 << BITS) + STATS
    mean, scale, bias, w, v = np.split(flat_model, np.cumsum([STATS, STATS, 1, n]))
    machine = Machine(mean, scale)
    machine.bias, machine.w, machine.v = float(bias[0]), w, v.reshape(n, RANK)
    return machine


def classify(docs: DataFrame, machine: Machine | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``."""
    if machine is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 2_000_000):
                score = shared.value.probability(*features(part, batch.column(2).slice(at, len(part))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
                at += len(part)

    return _inputs(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the labels (doc_id, quality) of rows not held out."""
    seen = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    out = classify(docs, fit(docs, seen, train_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""Operator 13: hard negatives by an inverted multi-index.

1. A vector's halves are coded by two codebooks, fitted on at most ``SAMPLE`` rows; a pair of codes is a cell.
   Every row is in a cell; a code's radius is the largest distance of a half to its centre, over all rows.
   Cells lie in blocks of about ``BLOCK_ROWS`` rows, so that a cell with very many rows is many blocks.
2. No row of a cell scores more than the sum, over both halves, of the anchor's product with the centre and its
   length times the radius.  A heap goes through an anchor's cells in descending order of that sum
   (multi-sequence), and leaves out cells without rows.
3. Cells are visited in rounds.  In a round, anchors ask for their next cells; requests of up to about
   ``ANCHORS`` anchors meet a cell's blocks in one product.  First the positives are sought, then the windows
   of scores that they define.  An anchor asks no more once the next sum certifies its result: what it has
   found is above that sum, or the sum is below the window.  Results are exact at any stop.

How far an anchor goes depends on the data: in clusters of close vectors a few cells do; vectors without
structure have nearly the same sum everywhere, and all cells are visited, in blocks.

Cases: a row without an id takes no part, nor does one with a null label, vector or component, or one that isn't
finite; rows that repeat an id count once (the smallest label, then vector); components beyond 2**23 in size
after scaling are set to that; shorter vectors are continued by zeros; ties go to the smaller id; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

POSITIVES, NEGATIVES = 5, 10
#: A row is an anchor if this divides its id; labels move on where ``SHIFTED`` does.
ANCHOR, SHIFTED = 100, 7
#: Hundredths of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
LIMIT = 1 << 23
SAMPLE, STEPS = 8192, 8
#: Rows of a cell on average, as far as the number of codes allows, and codes of a half at most.
CELL_ROWS, CODES = 256, 128
BLOCK_ROWS, ANCHORS = 512, 256
#: Cells that an anchor asks for in the first round; those visited grow by ``GROWTH`` a round.
FIRST, GROWTH = 16, 16
#: Lists of best rows that a task holds before it hands them on.
HELD = 50_000


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label and vec (int32 little-endian) of the rows that take part."""
    for batch in batches:
        keep, vectors = [], []
        lists = batch.column(2)
        for k in range(len(lists)):
            x = lists[k].values
            if x is None or x.null_count:
                continue
            x = np.floor(256 * x.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                keep.append(k)
                vectors.append(np.clip(x, -LIMIT, LIMIT).astype("<i4").tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(vectors, pa.binary())], ["vec_id", "label", "vec"])


def prepared(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")
    scaled = rows.mapInArrow(_scaled, "vec_id long, label long, vec binary")
    return scaled.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, which hold sums of their products exactly."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        x = np.frombuffer(v.as_buffer(), "<i4")
        out[k, : len(x)] = x
    return out


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def codebook(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` centres of ``x`` by k-means, from rows drawn by their squared distances."""
    rng = np.random.default_rng(13)
    centres = x[:1].copy()
    least = _squared(x, centres)[:, 0]
    while len(centres) < n and least.any():
        centres = np.concatenate([centres, x[rng.choice(len(x), p=least / least.sum())][None]])
        least = np.minimum(least, _squared(x, centres[-1:])[:, 0])
    for _ in range(STEPS):
        code = _squared(x, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (own := code == c).any():
                centres[c] = x[own].mean(axis=0)
    return centres


def _coded(width: int, books: tuple[np.ndarray, np.ndarray]):
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(2), width)
            columns = [*batch.columns]
            for part, centres in zip((x[:, :half], x[:, half:]), books, strict=True):
                code = _squared(part, centres).argmin(axis=1)
                columns += [pa.array(code), pa.array(np.sqrt(((part - centres[code]) ** 2).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vec", "i", "d_i", "j", "d_j"])

    return run


class Index:
    """Codebooks, radii and the rows of each cell (all of bounded size), by which cells are visited."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, radii: tuple[np.ndarray, np.ndarray]) -> None:
        self.books, self.counts, self.radii = books, counts, radii
        self.parts = -(-counts // BLOCK_ROWS)

    def width(self) -> int:
        return self.books[0].shape[1] + self.books[1].shape[1]

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        return tuple(c @ q + np.linalg.norm(q) * r for c, r, q in zip(self.books, self.radii, (x[:half], x[half:]), strict=True))

    def cells(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells with rows and the largest score that one of their rows can have, in descending order of it."""
        a, b = self.sums(x)
        first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap = [(-(a[first[0]] + b[second[0]]), 0, 0)]
        while heap:
            s, i, j = heapq.heappop(heap)
            if self.counts[first[i], second[j]]:
                # room for rounding
                yield int(first[i]) * len(b) + int(second[j]), int(np.floor(-s + 1e-3 + 1e-9 * abs(s)))
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[first[i]] + b[second[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[first[i + 1]] + b[second[0]]), i + 1, 0))


def fitted(rows: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index of ``rows`` (vec_id, label, vec; a written table), and their blocks; None where there are none."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("width")).first()
    if not size["n"]:
        return None
    width = max(2, size["width"] // 4)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    x = _vectors(sample, width)
    n = int(np.clip(round((size["n"] / CELL_ROWS) ** 0.5), 1, CODES))
    books = (codebook(x[:, : width // 2], n), codebook(x[:, width // 2 :], n))
    coded = staged(rows.mapInArrow(_coded(width, books), "vec_id long, label long, vec binary, i long, d_i double, j long, d_j double"), "coded")
    counts, radii = np.zeros([len(c) for c in books], np.int64), tuple(np.zeros(len(c)) for c in books)
    # at most CODES * CODES rows
    for r in coded.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("d_i").alias("d_i"), F.max("d_j").alias("d_j")).collect():
        counts[r["i"], r["j"]] = r["n"]
        radii[0][r["i"]] = max(radii[0][r["i"]], r["d_i"])
        radii[1][r["j"]] = max(radii[1][r["j"]], r["d_j"])
    index = Index(books, counts, radii)
    parts = spark.createDataFrame([(int(i), int(j), int(p)) for (i, j), p in np.ndenumerate(index.parts) if p], "i long, j long, parts long")
    dealt = coded.join(F.broadcast(parts), ["i", "j"]).select((F.col("i") * len(books[1]) + F.col("j")).alias("cell"), F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), "vec_id", "label", "vec")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(n_tasks, "cell", "part").sortWithinPartitions("cell", "part", "vec_id").mapInArrow(_packed(width), "cell long, part long, ids binary, labels binary, vectors binary")
    return index, staged(blocks, "blocks")


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), *(pa.array([c.tobytes()], pa.binary()) for c in (ids, labels, x.astype("<i4")))], ["cell", "part", "ids", "labels", "vectors"])

        for batch in batches:
            cell, part, ids, labels = (batch.column(k).to_numpy() for k in range(4))
            x = _vectors(batch.column(4), width)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if a == b:
                    continue
                if held and place != (cell[a], part[a]):
                    yield close()
                place = (cell[a], part[a])
                held.append((ids[a:b], labels[a:b], x[a:b]))
        if held:
            yield close()

    return run


def _visits(index: Index, begin: int, end: int):
    """Requests for the cells ``begin`` to ``end`` of each anchor: rows (cell, part, and the anchors' data packed).

    Comes with rows (group, anchor_id, label, vec, windows) in order of groups, a group's at once.  A window
    (key, low, high, least) takes scores from low to high; with ``least`` set, it is full and its last score is
    that.
    """

    def requests(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, list[dict]]]] = {}
        vectors = _vectors(pa.array([r[3] for r in rows], pa.binary()), index.width())
        for k, (_, _, _, _, windows) in enumerate(rows):
            for at, (cell, bound) in enumerate(index.cells(vectors[k])):
                if at < begin:
                    continue
                # a score as large as the sum may come with a smaller id
                open_windows = [w for w in windows if w["low"] <= min(bound, w["high"]) and (w["least"] is None or w["least"] <= bound)]
                if at >= end or not open_windows:
                    break
                asked.setdefault(cell, []).append((k, open_windows))
        for cell, own in asked.items():
            of = np.array([k for k, ws in own for _ in ws])
            windows = [w for _, ws in own for w in ws]
            some, place = np.unique(of, return_inverse=True)
            least = [w["low"] if w["least"] is None else max(w["low"], w["least"]) for w in windows]
            packed = [
                np.array([rows[k][1] for k in some], np.int64), np.array([rows[k][2] for k in some], np.int64), vectors[some].astype("<i4"),
                place.astype(np.int64), np.array([w["key"] for w in windows], np.int64), np.array(least, np.int64), np.array([w["high"] for w in windows], np.int64),
            ]
            n = int(index.parts.flat[cell])
            binary = [pa.array([c.tobytes()] * n, pa.binary()) for c in packed]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, cell)), pa.array(np.arange(n)), *binary], ["cell", "part", *_PACKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield from requests(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from requests(rows)

    return run


_PACKED = ["anchors", "anchor_labels", "anchor_vectors", "window_of", "keys", "lows", "highs"]


class Best:
    """The best rows of each window, that a task has seen."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.lists:
            old, old_ids = self.lists[key]
            scores, ids = np.concatenate([old, scores]), np.concatenate([old_ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.lists[key] = scores[order], ids[order]

    def least(self, key: tuple[int, int], low: int) -> int:
        found = self.lists.get(key)
        return low if found is None or len(found[0]) < self.k else max(low, int(found[0][-1]))

    def batch(self) -> pa.RecordBatch:
        n = np.array([len(s) for s, _ in self.lists.values()], np.int64)
        keys = np.repeat(np.array([*self.lists], np.int64).reshape(-1, 2), n, axis=0)
        scores = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in self.lists.values())])
        ids = np.concatenate([np.zeros(0, np.int64), *(i for _, i in self.lists.values())])
        self.lists.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(scores), pa.array(ids)], ["anchor_id", "key", "score", "vec_id"])


def _scored(width: int, same: bool, k: int):
    """The best rows of each window from joined requests and blocks: of the anchor's label if ``same``, else of
    others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                *packed, ids, labels, vectors = (c.as_buffer() for c in row)
                anchors, own, of, keys, lows, highs = (np.frombuffer(packed[p], np.int64) for p in (0, 1, 3, 4, 5, 6))
                q = np.frombuffer(packed[2], "<i4").reshape(-1, width).astype(np.float64)
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                scores = (q @ np.frombuffer(vectors, "<i4").reshape(-1, width).astype(np.float64).T).astype(np.int64)
                wanted = (labels == own[:, None]) == same
                if same:
                    wanted &= ids != anchors[:, None]
                for w, a in enumerate(of):
                    key = (int(anchors[a]), int(keys[w]))
                    good = np.flatnonzero(wanted[a] & (scores[a] >= best.least(key, int(lows[w]))) & (scores[a] <= highs[w]))
                    if len(good):
                        best.add(key, scores[a][good], ids[good])
                if len(best.lists) > HELD:
                    yield best.batch()
        yield best.batch()

    return run


_FULL = 1 << 62


def _searched(index: Index, blocks: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor_id, key, score and vec_id of the best ``k`` rows of each window (anchor_id, key, low, high)."""
    spark = blocks.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = windows.select("anchor_id", "key", F.col("low").alias("score"), F.col("key").alias("vec_id")).limit(0)
    begin, end, cells = 0, FIRST, int((index.counts > 0).sum())
    while begin < cells:
        full = found.groupBy("anchor_id", "key").agg(F.count("*").alias("_n"), F.min("score").alias("_least")).where(F.col("_n") >= k)
        now = windows.join(full, ["anchor_id", "key"], "left").groupBy("anchor_id").agg(F.collect_list(F.struct("key", "low", "high", F.col("_least").alias("least"))).alias("windows"))
        asking = anchors.join(now, "anchor_id").select("group", "anchor_id", "label", "vec", "windows")
        dealt = asking.repartition(n_tasks, "group").sortWithinPartitions("group", "anchor_id")
        requests = staged(dealt.mapInArrow(_visits(index, begin, end), "cell long, part long, " + ", ".join(f"{c} binary" for c in _PACKED)), "requests")
        if requests.isEmpty():
            break
        met = requests.join(blocks, ["cell", "part"]).select(*_PACKED, "ids", "labels", "vectors")
        seen = found.unionByName(met.mapInArrow(_scored(index.width(), same, k), "anchor_id long, key long, score long, vec_id long"))
        order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
        found = staged(seen.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank"), "found")
        begin, end = end, end * GROWTH
    return found


_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = staged(prepared(embeddings), "vectors")
    made = fitted(rows)
    if made is None:
        return spark.createDataFrame([], _SCHEMA)
    index, blocks = made
    anchors = rows.where(F.col("vec_id") % ANCHOR == 0).withColumnRenamed("vec_id", "anchor_id")
    groups = -(-anchors.count() // ANCHORS)
    anchors = staged(anchors.withColumn("group", F.pmod(F.xxhash64("anchor_id"), F.lit(max(1, groups)))), "anchors")
    every = anchors.select("anchor_id", F.lit(0).cast("long").alias("key"), F.lit(-_FULL).alias("low"), F.lit(_FULL).alias("high"))
    positives = _searched(index, blocks, anchors, every, True, POSITIVES)
    score = F.col("score")
    # whole numbers from LOW to HIGH hundredths of the score
    low, high = -F.expr(f"(-{LOW} * score - pmod(-{LOW} * score, 100)) div 100"), F.expr(f"({HIGH} * score - pmod({HIGH} * score, 100)) div 100")
    windows = staged(positives.select("anchor_id", F.col("vec_id").alias("key"), low.alias("low"), high.alias("high"), score.alias("positive_score")), "windows")
    negatives = _searched(index, blocks, anchors, windows.drop("positive_score"), False, NEGATIVES)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = negatives.withColumn("rank", F.row_number().over(order)).join(windows.select("anchor_id", "key", "positive_score"), ["anchor_id", "key"])
    return ranked.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Operator 10: MinHash near-duplicates by an LSH forest, with exact confirmation.

1. A document's set holds the hashes of its distinct 5-word shingles; documents with equal sets form a
   class, represented by its smallest id.
2. A representative's signature is ``TREES * DEPTH`` minimum hashes.  Tree t orders all representatives by
   the signature read from hash ``DEPTH * t`` on, around the ring.  Those that agree in the first DEPTH
   hashes form a region.  A region of up to ``WINDOW`` rows is compared whole, also where a partition ends
   within it; in a denser one a row meets the ``WINDOW`` rows behind it in the order, those of the longest
   common prefixes, so that the depth at which texts are told apart follows the region.  A pair at similarity
   0.75 meets in some region but for 2 in a million cases.  Dense regions come from passages that many texts
   share; texts that are similar by half through them join one cluster, which is confirmed whole.  With less
   in common, a pair still meets in a region of its own in 998 of 1000 cases, whatever the dense ones hold:
   it shares three hashes of which one lies outside the passage in a tree with probability
   0.75**3 - 0.583**3 = 0.22.  Measured on 100,400 made sets with a common passage: all 400 planted pairs at
   0.75 to 0.78 met, with 0.28 in common among the others (largest region 56,225 rows, largest cluster 997),
   and with 0.43 (66,621 rows, one cluster of 97,053).
3. Candidates whose signatures agree in ``LEAST_AGREEMENT`` of all places join into clusters.
4. A cluster is confirmed on full sets: every pair of different components is decided, so that no link
   inside it is lost.  One of at most ``CLUSTER_SHINGLES`` shingles is confirmed by one task (see
   ``Cluster.components``), larger ones in blocks by many (see ``large_components``).

Cases: a null text, and one without words, has an empty set and is linked with nothing; rows that repeat an
id count once; a row without an id is linked with nothing and stays, its component is null; a text of any
length gives its whole set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, staged
from .components import connected_components
from .hashing import mix, shingle_sets
from .tokens import slices

TREES, DEPTH = 24, 3
#: Rows behind one in a tree's order with which it is compared.
WINDOW = 256
#: Rows of a partition of a tree's order, on average and at least: many more than the window.
PARTITION_ROWS = 16 * WINDOW
#: Share of equal minimum hashes from which candidates join a cluster; five deviations under 0.75.
LEAST_AGREEMENT = 0.5
#: Shingles of a cluster that one task confirms (8 bytes each), and as how many more a set counts.
CLUSTER_SHINGLES, SET_SHINGLES = 4_000_000, 200
#: Sets of a large cluster that are compared with all in one round; one of so many shingles helps to choose
#: them.  Which sets they are bears on speed alone.
CENTRAL, SHINGLE_SAMPLE = 8, 16
#: Similarity of a link, in hundredths.
LINK = 75
#: Up to so many ids are broadcast to find their texts; more are joined.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = (_SEEDS.astype(np.uint32) | np.uint32(1))
_PLUS = (_SEEDS >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum hashes (32 bits) of a set that isn't empty."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    x = low[:, None] * _TIMES + (high[:, None] ^ _PLUS)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    return x.min(axis=0)


def _signed(shingles: np.ndarray) -> np.ndarray:
    best = None
    for at in range(0, len(shingles), 2048):
        found = signature(shingles[at : at + 2048])
        best = found if best is None else np.minimum(best, found)
    return best


def signature_bytes(sig: np.ndarray) -> bytes:
    """A byte of each minimum, spread over all its bits: the high ones are zero in every long text's."""
    return (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, two hashes of the set, the trees' region keys, and the signature in bytes."""
    for batch in batches:
        at = 0
        for part in slices(batch.column(1), 2_000_000):
            sets = shingle_sets(part)
            doc_ids = batch.column(0).slice(at, len(part))
            at += len(part)
            rows: list[tuple] = []
            for s in sets:
                if not len(s):
                    rows.append((0, 0, 0, [], b""))
                    continue
                sig = _signed(s)
                heads = sig.reshape(TREES, DEPTH).astype(np.uint64)
                keys = mix((heads * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)).sum(axis=1) + np.arange(TREES, dtype=np.uint64))
                a, b = int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))
                rows.append((len(s), a, b, keys.view(np.int64), signature_bytes(sig)))
            n, a, b, keys, sig = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "keys", "sig"],
            )


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(released(_digests), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, sig binary")


def neighbours(key: np.ndarray, sig: np.ndarray, held: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of candidates among rows in order of (key, sig): rows of one key at most ``WINDOW`` apart
    that agree in ``LEAST_AGREEMENT`` of the signature.

    Of candidates that join the same rows some are given, the nearest first, so that there are fewer of them
    than rows; all next neighbours are.  Pairs within the first ``held`` rows are left out.
    """
    at = np.flatnonzero(key[:-1] == key[1:])
    linked = np.zeros(len(key), bool)
    close = at[(sig[at] == sig[at + 1]).mean(axis=1) >= LEAST_AGREEMENT] if len(at) else at
    linked[close + 1] = True
    # rows that pairs join so far have the same number
    joined = np.cumsum(~linked)
    every = np.arange(len(key) + 1)
    close = close[close + 1 >= held]
    left, right = [close], [close + 1]
    for step in range(2, WINDOW + 1):
        at = at[at < len(key) - step]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        apart = at[(joined[at] != joined[at + step]) & (at + step >= held)]
        if not len(apart):
            continue
        close = apart[(sig[apart] == sig[apart + step]).mean(axis=1) >= LEAST_AGREEMENT]
        if not len(close):
            continue
        fresh, root = [], {}

        def top(x: int, root: dict[int, int] = root) -> int:
            while x in root:
                x = root[x]
            return x

        for i, u, v in zip(close.tolist(), joined[close].tolist(), joined[close + step].tolist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                fresh.append(i)
        numbers = every.copy()
        for x in root:
            numbers[x] = top(x)
        joined = numbers[joined]
        left.append(np.array(fresh))
        right.append(np.array(fresh) + step)
    return np.concatenate(left), np.concatenate(right)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of rows (key, sig, doc_id, ...) that come in order; beside them, as rows (border,
    key, sig, doc_id), the first rows of the partition's first region and the last ones of its last, which meet
    those across its borders."""
    part = TaskContext.get().partitionId()
    none = pa.schema([("border", pa.int64()), ("key", pa.int64()), ("sig", pa.binary()), ("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def edge(border: int, key: np.ndarray, sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, border)), pa.array(key), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(doc), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=none)

    held_key, held_doc, held_sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TREES * DEPTH), np.uint8)
    head, first = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([held_key, batch.column(0).to_numpy()])
        doc = np.concatenate([held_doc, batch.column(2).to_numpy()])
        sig = np.concatenate([held_sig, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)])
        i, j = neighbours(key, sig, len(held_key))
        a, b = doc[i], doc[j]
        n = len(a)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=none)
        if head < WINDOW:
            first = key[0] if first is None else first
            new = np.flatnonzero(key[len(held_key) :] == first)[: WINDOW - head] + len(held_key)
            yield edge(part - 1, key[new], sig[new], doc[new])
            head = head + len(new) if key[-1] == first else WINDOW
        held_key, held_doc, held_sig = key[-WINDOW:], doc[-WINDOW:], sig[-WINDOW:]
    if len(held_key):
        last = np.flatnonzero(held_key == held_key[-1])
        yield edge(part, held_key[last], held_sig[last], held_doc[last])


_PAIRS = "border long, key long, sig binary, doc_id long, a long, b long"


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a < b) of ``reps`` (doc_id, keys, sig), a table read from files."""
    spark = reps.sparkSession
    rows = reps.select("doc_id", "sig", F.posexplode("keys").alias("tree", "key"))
    start = F.col("tree") * DEPTH
    # the signature from the tree's place on, around the ring
    ring = F.concat(F.expr(f"substring(sig, {DEPTH} * tree + 1, {TREES * DEPTH})"), F.expr(f"substring(sig, 1, {DEPTH} * tree)"))
    rows = rows.select("key", F.when(start == 0, F.col("sig")).otherwise(ring).alias("sig"), "doc_id")
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + reps.count() * TREES // PARTITION_ROWS)
    # by range, so that a dense region spreads over partitions
    ordered = rows.repartitionByRange(n, "key", "sig", "doc_id").sortWithinPartitions("key", "sig", "doc_id")
    found = staged(ordered.mapInArrow(released(_pairs), _PAIRS), "neighbours")
    # the rows about each border are compared once more, as regions of their own
    about = found.where("border IS NOT NULL").select(F.xxhash64("border", "key").alias("key"), "sig", "doc_id")
    across = about.repartition(max(1, n // 16), "key").sortWithinPartitions("key", "sig", "doc_id").mapInArrow(released(_pairs), _PAIRS)
    return found.unionByName(across).where("a IS NOT NULL").select("a", "b").distinct()


class Cluster:
    """Components of a cluster's sets under ``100 * intersection >= LINK * union``."""

    def __init__(self, sets: list[np.ndarray], root: np.ndarray | None = None) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.root = np.arange(len(sets)) if root is None else root

    def index(self) -> None:
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        fresh = np.concatenate([[True], np.diff(flat[order]) > 0])
        code = np.empty(len(flat), np.int64)
        code[order] = np.cumsum(fresh) - 1
        self.posting = owner[order]
        self.first = np.flatnonzero(fresh)
        self.last = np.concatenate([self.first[1:], [len(flat)]])
        self.code, self.begin = code, np.cumsum(self.sizes) - self.sizes
        self.codes = np.split(code, self.begin[1:])
        self.marked = np.zeros(len(self.first), bool)

    def linked(self, i: int) -> np.ndarray:
        """Every set that is linked with set ``i``, from the inverted index.

        A linked set shares ``LINK`` hundredths of this set's shingles, so it holds one of any that are one
        more than the rest: only sets with one of those, the rarest, are compared.
        """
        codes = self.codes[i]
        n = self.last[codes] - self.first[codes]
        rare = codes[np.argsort(n, kind="stable")[: len(codes) - -(-LINK * len(codes) // 100) + 1]]
        others = np.unique(self.posting[self._spans(self.first[rare], self.last[rare])])
        if n.sum() < self.sizes[others].sum():
            both = np.bincount(self.posting[self._spans(self.first[codes], self.last[codes])], minlength=len(self.sets))[others]
        else:
            self.marked[codes] = True
            sizes = self.sizes[others]
            both = np.add.reduceat(self.marked[self.code[self._spans(self.begin[others], self.begin[others] + sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
            self.marked[codes] = False
        return others[100 * both >= LINK * (self.sizes[i] + self.sizes[others] - both)]

    @staticmethod
    def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = last - first
        return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def join(self, i: int) -> np.ndarray:
        """Joins the components that set ``i`` is linked with; a linked set of each but its own."""
        found = self.linked(i)
        labels, at = np.unique(self.root[found], return_index=True)
        others = found[at[labels != self.root[i]]]
        self.root[np.isin(self.root, labels)] = labels[0]
        return others

    def components(self) -> np.ndarray:
        """A component number per set.

        The most central sets (whose shingles are the commonest) go first; then each set outside the
        largest component is compared with all, as a pair of different components has one such set.
        """
        n = len(self.sets)
        if n == 2:
            both = len(np.intersect1d(*self.sets, assume_unique=True))
            return np.zeros(2, int) if 100 * both >= LINK * (self.sizes.sum() - both) else np.arange(2)
        self.index()
        common = np.array([(self.last[c] - self.first[c]).mean() for c in self.codes])
        seen = np.zeros(n, bool)
        for i in np.argsort(-common, kind="stable")[:8]:
            self.join(i)
            seen[i] = True
        while True:
            counts = np.bincount(self.root, minlength=n)
            outside = np.flatnonzero((self.root != counts.argmax()) & ~seen)
            if not len(outside):
                return self.root
            self.join(outside[0])
            seen[outside[0]] = True


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of clusters from rows (cluster, doc_id, shingles) that come in cluster order."""
    cluster: int | None = None
    doc_ids: list[int] = []
    sets: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        docs = np.array(doc_ids, np.int64)
        root = Cluster(sets).components() if len(sets) > 1 else np.arange(len(sets))
        least = np.full(len(docs), np.iinfo(np.int64).max)
        np.minimum.at(least, root, docs)
        doc_ids.clear()
        sets.clear()
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(least[root])], ["doc_id", "component"])

    for batch in batches:
        for c, d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if c != cluster and sets:
                yield close()
            cluster = c
            doc_ids.append(d)
            sets.append(np.frombuffer(s.as_buffer(), np.uint64).copy())
    if sets:
        yield close()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in slices(batch.column(2), 2_000_000):
            sets = [s.tobytes() for s in shingle_sets(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(sets, pa.binary())], ["cluster", "doc_id", "shingles"])
            at += len(part)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the probes in each block with its sets, from rows (cluster, i, j, probe, doc_id, root,
    shingles) that come in order of blocks.  Of links that join the same components one is given."""
    block: tuple | None = None
    rows: list[tuple] = []

    def close() -> pa.RecordBatch:
        probe, docs, roots, sets = zip(*rows, strict=True)
        rows.clear()
        cluster = Cluster(list(sets), np.unique(np.array(roots, np.int64), return_inverse=True)[1])
        cluster.index()
        links = [(docs[k], docs[other]) for k in np.flatnonzero(probe) for other in cluster.join(k)]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for c, i, j, p, d, r, s in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6), strict=True):
            if (c, i, j) != block and rows:
                yield close()
            block = (c, i, j)
            rows.append((p, d, r, np.frombuffer(s.as_buffer(), np.uint64).copy()))
    if rows:
        yield close()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster, doc_id and shingle: those of each set whose hashes fall into the sample, or its least one."""
    for batch in batches:
        for c, d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shingles = np.frombuffer(s.as_buffer(), np.uint64)
            some = shingles[mix(shingles) % np.uint64(SHINGLE_SAMPLE) == 0]
            some = some if len(some) else shingles.min(keepdims=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c)), pa.array(np.full(len(some), d)), pa.array(some.view(np.int64))], ["cluster", "doc_id", "shingle"])


def central(sets: DataFrame) -> DataFrame:
    """The doc_id of the ``CENTRAL`` sets of each cluster whose shingles are the commonest in ``sets``."""
    rows = staged(sets.mapInArrow(_sampled, "cluster long, doc_id long, shingle long"), "sampled")
    counts = staged(rows.groupBy("cluster", "shingle").agg(F.count("*").alias("n")), "common")
    scores = rows.join(counts, ["cluster", "shingle"]).groupBy("cluster", "doc_id").agg(F.avg("n").alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= CENTRAL).select("doc_id").distinct()


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def block_links(sets: DataFrame, roots: DataFrame, probes: DataFrame, block: int) -> DataFrame:
    """Links (a, b) of ``probes`` (doc_id) with the sets of their clusters that lie in other components.

    A cluster's probes and its sets are dealt to blocks of about ``block`` shingles, and a task compares one
    block of each.
    """
    probe = F.col("_probe").isNotNull()
    rows = roots.join(probes.withColumn("_probe", F.lit(True)), "doc_id", "left")
    blocks = rows.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / block).alias("_n"), F.ceil(F.sum(F.when(probe, F.col("n_shingles"))) / block).alias("_m"))
    rows = sets.join(_few(staged(rows.drop("n_shingles").join(_few(staged(blocks.where("_m > 0"), "blocks")), "cluster"), "rows")), ["cluster", "doc_id"])

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def one(n: str) -> F.Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(n))

    fields = ["doc_id", "root", "shingles"]
    members = rows.select("cluster", every("_m").alias("i"), one("_n").alias("j"), F.lit(False).alias("probe"), *fields)
    probing = rows.where(probe).select("cluster", one("_m").alias("i"), every("_n").alias("j"), F.lit(True).alias("probe"), *fields)
    place = ["cluster", "i", "j"]
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.unionByName(probing).repartition(n, *place).sortWithinPartitions(*place, "doc_id").mapInArrow(released(_block_links), "a long, b long")


def _pair_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= LINK * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def large_components(sets: DataFrame, members: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """doc_id and component of ``members`` (doc_id, cluster, n_shingles), whose sets are compared in blocks.

    First the most central sets are compared with all of their cluster, and the candidate pairs that are
    still apart.  A pair of different components has a set outside the largest one: rounds of central sets go
    on among those while a round halves their number, then all that are left are compared with all.
    """

    def rooted() -> DataFrame:
        found = connected_components(links).withColumnsRenamed({"node": "doc_id", "component": "root"})
        return staged(members.join(found, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "roots")

    links = pairs.limit(0)
    probed = members.select("doc_id").limit(0)
    roots = members.withColumn("root", F.col("doc_id"))
    before = None
    while True:
        top = roots.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("_top"))
        outside = roots.join(_few(staged(top, "top")), "cluster").where(F.col("root") != F.col("_top.root")).select("cluster", "doc_id")
        outside = staged(outside.join(probed, "doc_id", "left_anti"), "outside")
        n = outside.count()
        if not n:
            return roots.select("doc_id", F.col("root").alias("component"))
        every = before is not None and 2 * n > before
        probes = outside.select("doc_id") if every else central(sets.join(_few(outside), ["cluster", "doc_id"]).select("cluster", "doc_id", "shingles"))
        probes = staged(probes, "probes")
        links = staged(links.unionByName(block_links(sets, roots, probes, block)), "links")
        roots = rooted()
        if every:
            return roots.select("doc_id", F.col("root").alias("component"))
        if before is None:
            apart = pairs
            for x in "ab":
                apart = apart.join(_few(roots.select(F.col("doc_id").alias(x), F.col("root").alias(f"_root_{x}"))), x)
            apart = apart.where("_root_a != _root_b").select("a", "b")
            for x in "ab":
                apart = apart.join(sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"_{x}")), x)
            links = staged(links.unionByName(apart.select("a", "b", "_a", "_b").mapInArrow(_pair_links, "a long, b long")), "links")
            roots = rooted()
        probed = staged(probed.unionByName(probes), "probed")
        before = n


def confirmed(docs: DataFrame, clusters: DataFrame, pairs: DataFrame, limit: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id and component of the representatives in ``clusters`` (doc_id, n_shingles, cluster)."""
    sizes = clusters.groupBy("cluster").agg(F.sum(F.col("n_shingles") + SET_SHINGLES).alias("_size"))
    clusters = staged(clusters.join(sizes, "cluster"), "clusters")
    members = clusters.select("doc_id", "cluster")
    if clusters.count() <= BROADCAST_IDS:
        members = F.broadcast(members)
    sets = docs.select("doc_id", "text").join(members, "doc_id").select("cluster", "doc_id", "text").mapInArrow(released(_sets), "cluster long, doc_id long, shingles binary")
    sets = staged(sets, "sets")
    large = clusters.where(F.col("_size") > limit).select("cluster").distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = sets.join(large, "cluster", "left_anti").repartition(n, "cluster").sortWithinPartitions("cluster", "doc_id")
    out = small.mapInArrow(released(_confirm), "doc_id long, component long")
    if large.isEmpty():
        return out
    rest = staged(sets.join(_few(large), "cluster", "left_semi").dropDuplicates(["doc_id"]), "large")
    members = staged(clusters.where(F.col("_size") > limit).select("doc_id", "cluster", "n_shingles").dropDuplicates(["doc_id"]), "members")
    return out.unionByName(large_components(rest, members, pairs, max(1, limit // 4)))


def near_duplicates(docs: DataFrame, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = staged(digests(docs.where("doc_id IS NOT NULL")), "signatures")
    full = signed.where("n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    # the smallest id of each set, with what is the same for all of them
    reps = staged(full.groupBy(same).agg(F.min(F.struct("doc_id", "keys", "sig")).alias("r")).select(*same, "r.*"), "reps")
    pairs = staged(candidates(reps), "pairs")
    clusters = connected_components(pairs).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(reps.select("doc_id", "n_shingles"), "doc_id")
    found = staged(confirmed(docs, clusters, pairs, cluster_shingles), "components")
    members = full.select("doc_id", *same).join(reps.select(*same, F.col("doc_id").alias("rep")), same)
    known = members.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").distinct().join(known.distinct(), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    decided = out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    unnamed = digests(docs.where("doc_id IS NULL")).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return decided.unionByName(unnamed)

"""Operator 1: best-fit packing by swap-based local search.

``pieces`` turns texts into token pieces of at most ``length`` ids; ``pack`` lays pieces into sequences;
``sequences`` gives the packed ids themselves.

Packing runs in rounds.  Pieces are dealt evenly to shards by a hash; a task packs its shard best-fit
decreasing and improves it by exchanges between underfull bins (one piece moved, one for one, two for one
or one for two) that raise the sum of squared fills, until no bin can be saved or nothing improves.  Bins
with a gap of more than ``slack`` ids are opened again, and so many full ones with small pieces that the
pieces left are no longer than all were on average: small ones fill the gaps of later rounds.  What is left
enters the next round with as many fewer shards, until one shard holds it all.  A round that leaves over nine
tenths of its pieces doubles the slack of the next, so that rounds end where pieces cannot be combined.

Cases: a null or empty text is one piece with the end id alone; repeated rows are packed as often as they
occur; null ids pass through; an empty table gives an empty result; other columns of the input are ignored
by ``pieces`` and kept by ``pack``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, staged
from .tokens import IdEncoder, load

#: Pieces that one task packs.
SHARD_PIECES = 16_384
#: A bin with a larger gap is packed again in the next round.
SLACK = 2
#: The neighbourhood that is searched for an exchange: lengths tried for a place, and bins looked through for
#: two pieces to give.
TRIES, DONORS = 4, 6

_encoders: dict[tuple[str, bool], IdEncoder] = {}


def encoder(path: str, byte_level: bool) -> IdEncoder:
    """A worker's encoder for the file at ``path``; its chunk cache lasts from task to task."""
    if (path, byte_level) not in _encoders:
        _encoders[path, byte_level] = IdEncoder(load(path), byte_level)
    return _encoders[path, byte_level]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, byte_level: bool = False, with_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A document is the ids of its whole text, then ``end_id``; only longer ones are cut.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, byte_level)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.texts(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(released(cut), schema)


def pairs(items: list[int]) -> list[tuple[int, int]]:
    """The distinct pairs of lengths in one bin; a bin of 2048 has 63 distinct lengths at most."""
    distinct = sorted(set(items))
    twice = [(x, x) for x in distinct if items.count(x) > 1]
    return twice + [(x, y) for i, x in enumerate(distinct) for y in distinct[i + 1 :]]


class Bins:
    """Bins of one shard under local search; an item is its length, as equal lengths are alike."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, lengths: np.ndarray) -> None:
        """Lays ``lengths`` (descending) each into the fullest bin that has room for it."""
        room: dict[int, list[int]] = {}
        mask = 0  # bit r: some bin has r free
        for x in lengths.tolist():
            if fits := mask >> x:
                r = x + (fits & -fits).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    mask &= ~(1 << r)
            else:
                r, b = self.capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(x)
            self.fill[b] += x
            room.setdefault(r - x, []).append(b)
            mask |= 1 << (r - x)

    def improve(self) -> None:
        """Exchanges between underfull bins until no bin can be saved, or none raises the squared fill."""
        spare = len(self.fill) - -(-sum(self.fill) // self.capacity)
        order = [b for b, f in enumerate(self.fill) if f < self.capacity]
        self.holders: dict[int, set[int]] = {}
        self.mask = 0  # bit x: some underfull bin holds a piece of length x
        for b in order:
            for x in self.bins[b]:
                self._hold(x, b)
        while spare > 0:  # squares rise with every exchange, so this ends
            # fullest first: the bins behind give, so those at the end empty
            order.sort(key=lambda b: -self.fill[b])
            changed = 0
            for at, b in enumerate(order):
                while self.fill[b] < self.capacity and self._raise(b, order[max(at + 1, len(order) - DONORS) :]):
                    changed += 1
                if self.fill[b] == self.capacity:
                    for x in set(self.bins[b]):
                        self._drop(x, b)
            spare -= sum(not self.fill[b] for b in order)
            order = [b for b in order if 0 < self.fill[b] < self.capacity]
            if not changed:
                return

    def _hold(self, x: int, b: int) -> None:
        self.holders.setdefault(x, set()).add(b)
        self.mask |= 1 << x

    def _drop(self, x: int, b: int) -> None:
        self.holders[x].discard(b)
        if not self.holders[x]:
            self.mask &= ~(1 << x)

    def _giver(self, x: int, b: int) -> int | None:
        """A bin no fuller than ``b`` that holds a piece of length ``x``."""
        return next((a for a in self.holders[x] if a != b and self.fill[a] <= self.fill[b]), None)

    def _raise(self, b: int, donors: list[int]) -> bool:
        """The exchange that fills bin ``b`` most from an emptier one: a piece moved, one for one, one for
        two, or two (of the emptiest bins, ``donors``) for one."""
        gap, best = self.capacity - self.fill[b], (0, 0, (), ())
        ones: list[tuple[int, ...]] = [(), *((x,) for x in set(self.bins[b]))]
        for out in ones + pairs(self.bins[b]):
            given = sum(out)
            near = self.mask & ((2 << (given + gap)) - 1)
            for _ in range(TRIES):
                x = near.bit_length() - 1
                if x - given <= best[0]:
                    break
                if (a := self._giver(x, b)) is not None:
                    best = (x - given, a, (x,), out)
                    break
                near &= ~(1 << x)
            if best[0] == gap:
                break
        for a in reversed(donors):
            if best[0] == gap:
                break
            if self.fill[a] and self.fill[a] <= self.fill[b] and a != b and (two := pairs(self.bins[a])):
                gain = np.array([x + y for x, y in two])[:, None] - np.array([sum(o) for o in ones])
                gain[gain > gap] = 0
                if gain.max() > best[0]:
                    i, o = np.unravel_index(gain.argmax(), gain.shape)
                    best = (int(gain[i, o]), a, two[i], ones[o])
        if not best[0]:
            return False
        # squares rise: b was at least as full as a, and gains what a loses
        gained, a, taken, given = best
        for x, giver, taker in (*((x, a, b) for x in taken), *((x, b, a) for x in given)):
            self.bins[giver].remove(x)
            self.bins[taker].append(x)
            self._hold(x, taker)
            if x not in self.bins[giver]:
                self._drop(x, giver)
        self.fill[b] += gained
        self.fill[a] -= gained
        return True


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each length, and the fill of that bin."""
    order = np.argsort(-lengths, kind="stable")
    packed = Bins(capacity)
    packed.best_fit(lengths[order])
    packed.improve()
    flat = np.array([x for b in packed.bins for x in b], np.int64)
    owner = np.repeat(np.arange(len(packed.bins)), [len(b) for b in packed.bins])
    bins = np.empty(len(lengths), np.int64)
    bins[order] = owner[np.argsort(-flat, kind="stable")]
    return bins, np.array(packed.fill, np.int64)[bins]


def reopened(lengths: np.ndarray, bins: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The pieces (of those marked ``full``) of full bins that are opened again: bins with the smallest pieces
    first, until the open pieces' mean length is that of all."""
    n = np.bincount(bins)
    total = np.bincount(bins, weights=lengths)
    closed = np.unique(bins[full])
    closed = closed[np.argsort((total / np.maximum(n, 1))[closed], kind="stable")]
    count = np.count_nonzero(~full) + np.concatenate([[0], np.cumsum(n[closed])])
    length = lengths[~full].sum() + np.concatenate([[0], np.cumsum(total[closed])])
    enough = np.flatnonzero(length <= lengths.mean() * count)
    return full & np.isin(bins, closed[: enough[0] if len(enough) else 0])


def _shard_packer(capacity: int, level: int, slack: int, last: bool):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(shard, capacity, level, slack, last)

    return run


def _pack_shard(shard: pd.DataFrame, capacity: int, level: int, slack: int, last: bool) -> pd.DataFrame:
    shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    lengths = shard["length"].to_numpy()
    bins, fill = pack_lengths(lengths, capacity)
    shard["sequence_id"] = (level << 56) + (shard["_shard"].to_numpy() << 24) + bins
    shard["offset"] = shard.groupby(bins)["length"].cumsum().to_numpy() - lengths
    full = capacity - fill <= slack
    shard["_done"] = last | (full & ~reopened(lengths, bins, full))
    return shard.drop(columns="_shard")


def pack(parts: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES, slack: int = SLACK) -> DataFrame:
    """``parts`` (doc_id, piece, length and others) with sequence_id and offset: gapless from 0.

    Lengths must lie between 1 and ``capacity``.
    """
    columns = parts.columns
    # pieces without an id are dealt out by what else they have
    key = [f.name for f in parts.schema if not isinstance(f.dataType, T.ArrayType)]
    left = staged(parts, "pieces")
    done: list[DataFrame] = []
    n, level = left.count(), 0
    while n or not done:
        shards = max(1, -(-n // shard_pieces))
        keyed = left.withColumn("_shard", F.pmod(F.xxhash64(*key, F.lit(level)), F.lit(shards)))
        schema = T.StructType([*left.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")), T.StructField("_done", T.BooleanType())])
        packed = staged(keyed.groupBy("_shard").applyInPandas(_shard_packer(capacity, level, slack, shards == 1), schema), "packed")
        done.append(packed.where("_done"))
        if shards == 1:
            break
        left = packed.where("NOT _done").select(columns)
        before, n, level = n, left.count(), level + 1
        if n > 0.9 * before:
            slack = max(1, 2 * slack)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from packed pieces with ids: sequence_id, n_pieces, ids."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
        .select("sequence_id", "n_pieces", F.flatten("_parts.ids").alias("ids"))
    )

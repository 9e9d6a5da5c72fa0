"""Operator 12: spelling variants, by edits that are probed against Bloom filters of the vocabulary.

1. Words are counted with built-in functions; those seen often enough form the vocabulary, a written table.
2. The vocabulary goes into blocked Bloom filters, sharded by length and, beyond ``SLICE_WORDS`` words of a
   length, by hash.  A filter takes ``BITS`` bits a word.  Filters are broadcast in rounds of at most
   ``ROUND_BYTES``, so that what is broadcast doesn't grow with the vocabulary; only their number does.
3. Each word's edits are probed by their hashes, which follow from the word's own by arithmetic: every
   deletion, and every replacement by a later character.  An insertion is a deletion of the other word and a
   replacement by an earlier character is one by a later character of the other word, so each pair is found
   once.  Only where a filter says yes is the edited word spelled out.
4. Those words are joined with the vocabulary, which removes false positives; filters have no false negatives,
   so no pair is lost.
5. A word's form is its near word of the largest count, if that is ``RATIO`` times its own; forms are followed
   to the root by doubling, in at most a few steps as counts grow tenfold.

Cases: a null text has no words; a null id counts as an empty one in the hash that deletes code points; empty
tables give an empty result; rows that repeat an id are counted each; a text or word of any length is taken
whole; ties of counts go to the smallest word in code-point order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .hashing import BASE, INVERSE, VALUE

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a code point before it is counted.
DELETED = 31
#: The letters of words, once A-Z are lower-case: all of one byte in Latin-1.
LETTERS = "a-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a filter for each word, and probes of a word, all in one block of 64 bits.
BITS, PROBES = 24, 5
SLICE_WORDS = 250_000
ROUND_BYTES = 64 << 20
#: Edits whose hashes a task holds at a time.
EDITS = 1 << 20

_U = np.uint64


def words(text: Column, doc_id: Column) -> Column:
    """The words of a text, one in ``DELETED`` with a code point deleted, as an array."""
    runs = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"([{LETTERS}]{{{LEAST_LETTERS},}})"), F.lit(1))
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"))

    def word(run: Column) -> Column:
        h = F.crc32(F.concat(key, run))
        at = F.pmod(h, F.length(run)).cast("int")
        return F.when(h % DELETED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return F.transform(runs, word)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    found = docs.where("text IS NOT NULL").select(F.explode(words(F.col("text"), F.col("doc_id"))).alias("word"))
    counts = found.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _matrix(found: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint8).reshape(len(found), length)


def _terms(letters: np.ndarray) -> np.ndarray:
    """What each letter adds to its word's hash."""
    return VALUE[letters] * _powers(letters.shape[1])


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(length - 1, INVERSE, _U)]), dtype=_U) if length else np.ones(0, _U)


def _mixed(h: np.ndarray) -> np.ndarray:
    x = h * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x * _U(0xD6E8FEB86659FD93)


def _slice(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> _U(31)) % _U(n) if n > 1 else np.zeros(len(x), _U)


def _blocks(words_of_slice: int) -> int:
    return max(1, -(-words_of_slice * BITS // 64))


def _bit(x: np.ndarray, k: int) -> np.ndarray:
    return _U(1) << ((x >> _U(6 * k)) & _U(63))


def _by_length(found: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths, and the places of the words of each; no more of them than ``EDITS`` letters."""
    sizes = np.array([len(w) for w in found], np.int64)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        step = max(1, EDITS // int(length))
        for k in range(0, len(at), step):
            yield int(length), at[k : k + step]


class Filters:
    """The filters of some slices, by length: number of slices, blocks of a slice, first slice, bits."""

    def __init__(self, by_length: dict[int, tuple[int, int, int, np.ndarray]]) -> None:
        self.by_length = by_length

    def holds(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes of words with ``length`` letters that may be in the vocabulary."""
        if length not in self.by_length or not len(h):
            return np.zeros(0, np.int64)
        n, blocks, first, bits = self.by_length[length]
        x = _mixed(h)
        block = ((x >> _U(32)) * _U(blocks)) >> _U(32)
        if n > 1:
            part = _slice(x, n).astype(np.int64) - first
            at = np.flatnonzero((part >= 0) & (part < len(bits) // blocks))
            x, block = x[at], block[at] + (part[at] * blocks).astype(_U)
        else:
            at = np.arange(len(h))
        for k in range(PROBES):
            good = (bits[block] & _bit(x, k)) != 0
            at, x, block = at[good], x[good], block[good]
        return at


def edits(found: list[bytes], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Places in ``found`` (Latin-1) with the edited words that the filters may hold; each edited word once."""
    for length, at in _by_length(found):
        letters = _matrix([found[k] for k in at], length)
        terms = _terms(letters)
        whole = terms.sum(axis=1, dtype=_U)
        if length - 1 in filters.by_length:
            before = np.cumsum(terms, axis=1, dtype=_U) - terms
            # letters behind the deleted one move up by a place
            shorter = before + (whole[:, None] - before - terms) * BASE
            first = np.ones(letters.shape, bool)
            first[:, 1:] = letters[:, 1:] != letters[:, :-1]
            row, place = np.nonzero(first)
            hits = filters.holds(length - 1, shorter[row, place])
            yield at[row[hits]], [found[at[r]][:p] + found[at[r]][p + 1 :] for r, p in zip(row[hits], place[hits], strict=True)]
        if length in filters.by_length:
            rest, powers = (whole[:, None] - terms).ravel(), _powers(length)
            values = VALUE[alphabet]
            step = max(1, EDITS // max(1, len(alphabet)))
            flat = letters.ravel()
            for k in range(0, len(flat), step):
                place = np.arange(k, min(len(flat), k + step))
                pair, letter = np.nonzero(alphabet > flat[place, None])
                h = rest[place[pair]] + values[letter] * powers[place[pair] % length]
                hits = filters.holds(length, h)
                spot, new = place[pair[hits]], alphabet[letter[hits]]
                row, col = spot // length, spot % length
                yield at[row], [found[at[r]][:p] + bytes([c]) + found[at[r]][p + 1 :] for r, p, c in zip(row, col, new, strict=True)]


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _hashed(slices: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """length, slice and hash of each word."""
        for batch in batches:
            found = _latin(batch.column(0))
            for length, at in _by_length(found):
                x = _mixed(_terms(_matrix([found[k] for k in at], length)).sum(axis=1, dtype=_U))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length)), pa.array(_slice(x, slices[length]).astype(np.int64)), pa.array(x.view(np.int64))], ["length", "slice", "x"])

    return run


def _built(blocks: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filter of each slice, from rows (length, slice, x) that come in order."""
        place: tuple[int, int] | None = None
        bits = np.zeros(0, _U)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([bits.tobytes()], pa.binary())], ["length", "slice", "bits"])

        for batch in batches:
            length, part, x = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True):
                if a == b:
                    continue
                if place != (now := (int(length[a]), int(part[a]))):
                    if place:
                        yield close()
                    place, bits = now, np.zeros(blocks[now[0]], _U)
                own = x[a:b].view(_U)
                block = ((own >> _U(32)) * _U(len(bits))) >> _U(32)
                for k in range(PROBES):
                    np.bitwise_or.at(bits, block, _bit(own, k))
        if place:
            yield close()

    return run


def _probed(shared, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word, n and other: what may be a near word."""
        for batch in batches:
            found = _latin(batch.column(0))
            for rows, others in edits(found, alphabet, Filters(shared.value)):
                if others:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([o.decode("latin-1") for o in others])], ["word", "n", "other"])

    return run


def rounds(sizes: dict[int, tuple[int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """Slices (length, first, end) of each round, from the slices and blocks a slice of each length."""
    out: list[list[tuple[int, int, int]]] = [[]]
    left = most
    for length, (slices, blocks) in sorted(sizes.items()):
        first = 0
        while first < slices:
            n = min(slices - first, left // (8 * blocks))
            if n < 1 and out[-1]:
                out.append([])
                left = most
                continue
            n = max(n, 1)
            out[-1].append((length, first, first + n))
            left -= n * 8 * blocks
            first += n
    return out


def near_pairs(vocab: DataFrame, slice_words: int = SLICE_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n, other and other_n of near words of ``vocab`` (word, n; a written table); each pair once."""
    spark = vocab.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = {r["length"]: r["words"] for r in vocab.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("words")).collect()}
    slices = {k: -(-n // slice_words) for k, n in lengths.items()}
    blocks = {k: _blocks(-(-n // slices[k])) for k, n in lengths.items()}
    letters = vocab.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters if r["letter"]), np.uint8)
    hashed = vocab.select("word").mapInArrow(_hashed(slices), "length long, slice long, x long")
    built = hashed.repartition(n_tasks, "length", "slice").sortWithinPartitions("length", "slice").mapInArrow(_built(blocks), "length long, slice long, bits binary")
    filters = staged(built, "filters")
    dealt = staged(vocab.repartition(n_tasks, "word"), "dealt")
    found = None
    for chosen in rounds({k: (slices[k], blocks[k]) for k in lengths}, round_bytes):
        if not chosen:
            continue
        wanted = " OR ".join(f"(length = {k} AND slice >= {a} AND slice < {b})" for k, a, b in chosen)
        parts = {(r["length"], r["slice"]): r["bits"] for r in filters.where(wanted).collect()}
        empty = {k: bytes(8 * blocks[k]) for k, _, _ in chosen}
        shared = spark.sparkContext.broadcast({k: (slices[k], blocks[k], a, np.frombuffer(b"".join(parts.get((k, s), empty[k]) for s in range(a, b)), _U)) for k, a, b in chosen})
        probing = sorted({k for c in chosen for k in (c[0], c[0] + 1)} & lengths.keys())
        some = dealt.where(F.length("word").isin(probing)).mapInArrow(_probed(shared, alphabet), "word string, n long, other string")
        found = staged(some if found is None else found.unionByName(some), "positives")
        shared.destroy()
    if found is None:
        return vocab.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    return found.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form): the last one to which forms lead."""
    found = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.join(found.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        step = staged(onward.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        found = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return found


def variants(docs: DataFrame, slice_words: int = SLICE_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocab = staged(vocabulary(docs), "vocabulary")
    pairs = staged(near_pairs(vocab, slice_words, round_bytes), "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"))
    decided = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("b.m") >= RATIO * F.col("n"), F.struct(F.col("b.other").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f"))
    decided = staged(decided.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    found = roots(decided.where("form IS NOT NULL"))
    out = decided.join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

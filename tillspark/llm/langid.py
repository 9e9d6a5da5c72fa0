"""Operator 7: language identification by interpolated Kneser-Ney character models.

Each language has a model of ORDER-character strings inside words (lower-cased runs of letters between word
ends).  The models share sorted arrays of string hashes; next to each hash stand, per language, the
discounted probability of the string's last character and the weight of the shorter context.  A document
gets the language of the lowest cross-entropy per character; whether that is low enough for the language
(``accepted``) is calibrated on other labelled rows than the models were learned from.

Training takes at most ``TRAIN_DOCS`` documents of a language, those with the smallest hashes of their ids;
every ``CALIBRATION``-th of them in that order is left out of the models and sets the limit (a language with fewer
documents than that is always accepted).

Cases: texts that are null or without a letter are `und` with score 0, as is every text when there is
nothing to learn from; rows with a null language are never learned from; repeated rows are judged alike; of
languages that fit equally well the first by name is given; all of a text of any length counts; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, staged
from .hashing import mix
from .tokens import LONGEST_CACHED, slices

ORDER = 4
TRAIN_DOCS = 2000
DISCOUNT = 0.75
CALIBRATION = 10
#: How much of a character's bits count in a score, as neighbouring characters depend on each other.
EVIDENCE = 0.25
#: Share of a language's training documents that stay accepted.
ACCEPTED = 0.999
CACHE_WORDS = 250_000
#: Stands before and behind a word.
EDGE = "\x02"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def word_lists(texts: pa.Array) -> pa.Array:
    """The lower-case runs of letters of each text; the first and last may be empty."""
    return pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " "), " ")


def gram_hash(codes: list[np.ndarray]) -> np.ndarray:
    """Hashes of strings whose k-th characters are ``codes[k]``."""
    out = np.full(len(codes[0]), len(codes), np.uint64)
    for c in codes:
        out = mix((out + c.astype(np.uint64)) * _STEP)
    return out


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all ``words``, each between ORDER - 1 edges and one, and where the words begin."""
    joined = "".join(EDGE * (ORDER - 1) + w + EDGE for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) + ORDER for w in words], np.int64)
    return codes, np.cumsum(sizes) - sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, string of ORDER characters, and how often it occurs."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        at = 0
        for part in slices(batch.column(1)):
            for lang, words in zip(batch.column(0).slice(at, len(part)).to_pylist(), word_lists(part), strict=True):
                counts.setdefault(lang, Counter()).update(words.as_py())
            at += len(part)
        for lang, words in counts.items():
            words.pop("", None)
            grams: Counter = Counter()
            for word, n in words.items():
                full = EDGE * (ORDER - 1) + word + EDGE
                for i in range(len(word) + 1):
                    grams[full[i : i + ORDER]] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


@dataclass
class Models:
    langs: list[str]
    keys: list[np.ndarray]  # by order, sorted hashes of strings
    given: list[np.ndarray]  # by order, string x language
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float
    limits: dict[str, float]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of log2 probabilities of each word under each language."""
        codes, starts = _places(words)
        sizes = np.diff(np.concatenate([starts, [len(codes)]]))
        inner = np.arange(len(codes)) - np.repeat(starts, sizes)
        ends = np.flatnonzero(inner >= ORDER - 1)
        p = np.full((len(ends), len(self.langs)), self.floor)
        for n in range(1, ORDER + 1):
            window = [codes[ends - n + 1 + k] for k in range(n)]
            p *= self._look(self.contexts[n - 1], self.weights[n - 1], gram_hash(window[:-1]) if n > 1 else np.zeros(len(ends), np.uint64), 1.0)
            p += self._look(self.keys[n - 1], self.given[n - 1], gram_hash(window), 0.0)
        firsts = np.concatenate([[0], np.cumsum(sizes - ORDER + 1)[:-1]])
        return np.add.reduceat(np.log2(p), firsts, axis=0)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], values[at], other)


def build(counts: pd.DataFrame) -> Models:
    """Interpolated Kneser-Ney models from counts of ORDER-character strings (lang, gram, n)."""
    langs = sorted(counts["lang"].unique())
    now = counts.groupby(["gram", "lang"])["n"].sum().unstack(fill_value=0)[langs]
    keys, given, contexts, weights = [], [], [], []
    characters = now.index.str[-1].nunique()
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # in how many longer strings a string is the end
            now = (now > 0).astype(int).groupby(now.index.str[1:]).sum()
        head = now.index.str[:-1]
        total = now.groupby(head).sum()
        kinds = (now > 0).groupby(head).sum()
        share = (now - DISCOUNT).clip(lower=0) / total.loc[head].to_numpy().clip(min=1)
        weight = np.where(total > 0, DISCOUNT * kinds / total.clip(lower=1), 1.0)
        for strings, values, to_keys, to_values in ((now.index, share.to_numpy(), keys, given), (total.index, weight, contexts, weights)):
            size = n if to_keys is keys else n - 1
            hashes = gram_hash([np.array([ord(s[k]) for s in strings]) for k in range(size)]) if size else np.zeros(len(strings), np.uint64)
            order = np.argsort(hashes)
            to_keys.insert(0, hashes[order])
            to_values.insert(0, np.asarray(values, float)[order])
    return Models(langs, keys, given, contexts, weights, 1.0 / (characters + 1), {})


_caches: dict[int, list[dict[str, bytes]]] = {}


def _entropies(models: Models, key: int, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of texts: bits of each text under each language, and its number of characters."""
    caches = _caches.setdefault(key, [{}, {}])
    for part in slices(texts, 4_000_000):
        lists = word_lists(part)
        starts = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        starts = starts - starts[0]
        known = words.dictionary.to_pylist()
        young, old = caches
        found = [young.get(w) or old.get(w) for w in known]
        new = [i for i, v in enumerate(found) if v is None and known[i]]
        if len(young) + len(new) > CACHE_WORDS:
            caches[:] = [{}, young]
            young = caches[0]
        sums = models.word_scores([known[i] for i in new]).astype("<f4") if new else []
        for i, v in zip(new, sums, strict=True):
            found[i] = v.tobytes()
            if len(known[i]) <= LONGEST_CACHED:
                young[known[i]] = found[i]
        nothing = np.zeros(len(models.langs), "<f4").tobytes()
        table = np.frombuffer(b"".join(v or nothing for v in found), "<f4").reshape(-1, len(models.langs))
        sizes = np.array([len(w) + 1 if w else 0 for w in known], np.int64)
        codes = words.indices.to_numpy()
        yield -np.add.reduceat(table[codes].astype(float), starts[:-1], axis=0), np.add.reduceat(sizes[codes], starts[:-1])


def smallest(rows: DataFrame, n: int) -> DataFrame:
    """The rows (doc_id, lang) that can be among the ``n`` of their language with the smallest id hashes, with
    that hash: ``n`` and a 4096th of the language's rows, about, as hashes are counted by their first 12 bits."""
    rows = rows.withColumn("hash", F.xxhash64(F.col("doc_id").cast("string")))
    part = F.shiftright("hash", 52)
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("part")) - F.col("count")
    counted = rows.groupBy("lang", part.alias("part")).count().withColumn("before", before)
    last = counted.where(F.col("before") < n).groupBy("lang").agg(F.max("part").alias("last"))
    return rows.join(F.broadcast(last), "lang").where(part <= F.col("last")).select("doc_id", "lang", "hash")


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Models | None:
    """Models of the languages in ``docs`` (doc_id, text, lang); None if there is nothing to learn from."""
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # ids alone are ranked, few more than are taken, and looked up in the table
    ranked = smallest(labelled.select("doc_id", "lang"), train_docs).withColumn("n", F.row_number().over(order))
    chosen = staged(ranked.where(F.col("n") <= train_docs).select("doc_id", "lang", (F.col("n") % CALIBRATION == 0).alias("apart")), "chosen")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    both = staged(labelled.join(chosen, ["doc_id", "lang"]).select("lang", "text", "apart"), "sample")
    sample = both.where("NOT apart")
    counts = sample.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    models = build(counts)
    scored = predict(both.where("apart").select(F.lit(0).cast("long").alias("doc_id"), "text", "lang"), models, "lang").where("lang_pred = lang")
    limits = scored.groupBy("lang").agg(F.percentile_approx("entropy", ACCEPTED, 10_000).alias("limit")).collect()
    models.limits = {r["lang"]: r["limit"] for r in limits}
    return models


def predict(docs: DataFrame, models: Models | None, *keep: str) -> DataFrame:
    """doc_id, ``keep``, lang_pred, score, entropy (bits a character under the best language) and accepted."""
    fields = ["doc_id", *keep]
    if models is None:
        return docs.select(*fields, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    version = zlib.crc32(models.given[-1].tobytes())
    schema = docs.select(*fields).schema.add("lang_pred", "string").add("score", "double").add("entropy", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        limits = np.array([m.limits.get(x, np.inf) for x in m.langs])
        for batch in batches:
            at = 0
            for bits, sizes in _entropies(m, version, batch.column(batch.num_columns - 1)):
                rate = bits / np.maximum(sizes, 1)[:, None]
                best = rate.argmin(axis=1)
                lead = rate.min(axis=1)
                odds = np.exp2(-(rate - lead[:, None]) * EVIDENCE * sizes[:, None])
                some = sizes > 0
                score = np.where(some, 1 / odds.sum(axis=1), 0.0)
                names = pa.array([m.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], pa.string())
                own = [batch.column(k).slice(at, len(best)) for k in range(len(fields))]
                entropy = pa.array(lead, mask=~some)
                yield pa.RecordBatch.from_arrays([*own, names, pa.array(score), entropy, pa.array(some & (lead <= limits[best]))], schema.names)
                at += len(best)

    return docs.select(*fields, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and accepted; learns from the rows not held out."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(marked, fit(marked.where("NOT held_out"), train_docs), "held_out")

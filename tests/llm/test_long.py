"""Texts of megabytes in every operator, Kneser-Ney against its definition, and the new queries against SQL."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillspark.llm import byte_bpe, exact, fm, idfile, langid, licenses, near, packing, pii, quality, queries, spelling, suffix
from tillspark.llm.common import fresh_path

from .test_rules import brute_statistics


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(8)
    return " ".join(f"{r.choice(('water', 'stone', 'river', 'Äpfel', 'été'))}{r.randint(0, 99_999)}" for _ in range(200_000))


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    """A text of two megabytes, a near copy, one that differs by white space, and short ones."""
    rows = [(1, long_text), (2, long_text + " one edit more"), (3, long_text.replace(" ", "\n\t")), (4, "short text of a few words"), (5, None), (6, "under the mit license " + "x" * 2_000_000)]
    return spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_tokens_of_long_texts(spark, long_docs, long_text):
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    packed = packing.pack(packing.pieces(long_docs, queries.vocabulary("word_bpe_49k.json"), 2048)).toPandas()
    for _, own in packed.sort_values("piece").groupby("doc_id"):
        assert (own["start"] == own["length"].cumsum() - own["length"]).all()
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 2048
    import public_tokenizers

    coded = by_id(byte_bpe.encode(long_docs, queries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True))
    assert bytes(coded[1].decoded).decode() == long_text and bytes(coded[5].decoded) == b""
    path = fresh_path(spark, "long-ids")
    idfile.write(long_docs, path, vocabulary)
    read = by_id(idfile.read(spark, path))
    assert read[1].n_tokens > 200_000 and read[5].n_tokens == 1 and read[2].start == read[1].start + read[1].n_tokens


def test_copies_of_long_texts(long_docs, long_text):
    same = by_id(exact.exact_dedup(long_docs))
    assert same[1].keep_id == same[3].keep_id == 3 and same[2].keep_id == 2
    linked = by_id(near.near_duplicates(long_docs))
    assert linked[2].component_id == linked[3].component_id == 1 and linked[4].component_id == 4
    cut = by_id(suffix.remove_repeats(long_docs))
    assert cut[1].n_removed == 0 and cut[2].n_removed == len(long_text.encode()) and cut[2].kept_text == " one edit more"
    # a run of one byte: each of its strings but the first starts later than an equal one
    assert cut[6].n_removed == 1_999_999


def test_rules_of_long_texts(long_docs, long_text):
    found = by_id(licenses.scan(long_docs))
    assert found[6].base_labels == "mit" and found[1].n_words == 200_000 and found[5].n_words == 0
    stats = by_id(quality.statistics(long_docs, "doc_id"))
    assert tuple(stats[1][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(long_text)
    assert quality.quality_rules(long_docs).count() == 6


def test_models_of_long_texts(spark, long_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, 1), (6, 0)], "doc_id long, quality int")
    scores = by_id(fm.quality_scores(long_docs, labels))
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores.values())
    langs = by_id(langid.identify(long_docs))
    assert langs[5].lang_pred == "und" and langs[1].lang_pred == "en"
    assert len(by_id(pii.personal_data(long_docs))) == 6
    assert spelling.variants(long_docs).where(F.length("word") > 100).isEmpty()


# Kneser-Ney by its definition.


class Plain:
    def __init__(self, words: Counter, characters: int) -> None:
        self.n: dict[int, Counter] = {langid.ORDER: Counter()}
        for word, times in words.items():
            full = langid.EDGE * (langid.ORDER - 1) + word + langid.EDGE
            for k in range(len(full) - langid.ORDER + 1):
                self.n[langid.ORDER][full[k : k + langid.ORDER]] += times
        for n in range(langid.ORDER - 1, 0, -1):
            self.n[n] = Counter(s[1:] for s in self.n[n + 1])
        self.follow = {n: defaultdict(dict) for n in self.n}
        for n, counts in self.n.items():
            for s, times in counts.items():
                self.follow[n][s[:-1]][s[-1]] = times
        self.floor = 1 / (characters + 1)

    def p(self, n: int, head: str, c: str) -> float:
        if n == 0:
            return self.floor
        rest = self.p(n - 1, head[1:], c)
        follow = self.follow[n].get(head)
        if not follow:
            return rest
        total = sum(follow.values())
        return max(follow.get(c, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(follow) / total * rest

    def score(self, word: str) -> float:
        full = langid.EDGE * (langid.ORDER - 1) + word + langid.EDGE
        n = langid.ORDER
        return sum(math.log2(self.p(n, full[k - n + 1 : k], full[k])) for k in range(n - 1, len(full)))


def test_kneser_ney_by_its_definition():
    r = random.Random(4)
    words = {lang: Counter("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(300)) for lang, letters in (("de", "abcäe"), ("en", "abcde"), ("fr", "aéèb"))}
    rows = []
    for lang, own in words.items():
        for word, times in own.items():
            full = langid.EDGE * (langid.ORDER - 1) + word + langid.EDGE
            rows += [(lang, full[k : k + langid.ORDER], times) for k in range(len(word) + 1)]
    models = langid.build(pd.DataFrame(rows, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False)["n"].sum())
    characters = len({g[-1] for _, g, _ in rows})
    tried = ["abc", "äää", "e", "zzz", "aéb", *(next(iter(own)) for own in words.values())]
    expected = [[Plain(words[lang], characters).score(w) for lang in models.langs] for w in tried]
    assert np.allclose(models.word_scores(tried), expected)


# SQL.


def rows_of(frame):
    names = sorted(frame.columns)
    values = frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None)
    return names, sorted(str(tuple(int(x) if isinstance(x, float) and x == int(x) else x for x in r)) for r in values)


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_hard_negatives"])
def test_query_equals_sql(spark, sf, name):
    connection = duckdb.connect()
    for t in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows_of(queries.queries()[name](spark, sf).toPandas()) == rows_of(connection.sql(queries.oracle_sql()[name]).df())


def test_digest_columns(spark, sf):
    """The personal-data query's columns, and that its base digest is of the base spans it counts."""
    rows = queries.op11_personal_data(spark, sf).collect()
    for r in rows:
        base = [s for s in r.spans.split(",") if s]
        counts = Counter(s.split(":")[0] for s in base)
        assert all(counts[k] >= n for k, n in zip(pii.BASE_KINDS, (r.n_email, r.n_ip, r.n_card, r.n_phone), strict=True))
        if not base:
            assert r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tillspark.llm import fm, langid, licenses, quality

from .conftest import prose

# Licences.

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_base(text):
    words = WORD.findall(text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def scan(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


def test_base_phrases(spark, docs, texts):
    more = ["Under the MIT License. Under the MIT\nLicense!", "apache-license: version-2 cc by nc cc-by-nc", "cc by ncx", "aunder the mit license", "the mit licensé under", "Ünder the mit license", "CC  BY__NC", "under the Kit license"]
    for text, r in zip(more, scan(spark, more), strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), text
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
    assert licenses.scan(docs.limit(0)).count() == 0


def test_rules_and_suppression(spark):
    cases = {
        "GNU General Public License version 3 or later": "gpl-3",
        "GNU General Public License": "gpl",
        "the GNU Lesser General Public License, Version 2.1": "lgpl-2.1",
        "SPDX-License-Identifier: Apache-2.0": "apache-2",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa-4",
        "licensed under the Mozilla Public License 2.0": "mpl-2",
        "cc by nc": "cc-by-nc",
        "cc by nc 4.0": "cc-by-nc,cc-by-nc-4",
        "All rights reserved. Under the MIT License": "mit,proprietary",
        "BSD 3-Clause License": "bsd-3-clause",
        "nothing here but mit and water": "",
        None: "",
    }
    for (text, labels), r in zip(cases.items(), scan(spark, list(cases)), strict=True):
        assert r.labels == labels, text
        assert (r.score > 0) == bool(labels) and 0 <= r.score <= 1
    assert len(licenses.rules()) > 200


def example(regex, r):
    """A string that a rule's regex matches: one of each group's alternatives, optional parts in or out."""
    while m := re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", regex):
        regex = regex[: m.start()] + r.choice(m[1].split("|") + [""] * (m[2] == "?")) + regex[m.end() :]
    regex = re.sub(r"\[(\w)(\w)\]", lambda m: r.choice(m.groups()), regex).replace("\\S+", "some")
    return re.sub(r"(.)\?", lambda m: r.choice([m[1], ""]), regex)


def test_every_rule_is_gated_rightly(spark):
    """What a rule can match holds its keyword and passes the prefilter."""
    r = random.Random(1)
    shown = {(rule.keyword, x) for rule in licenses.rules() for x in (example(rule.regex, r) for _ in range(40)) if re.fullmatch(rule.regex, x)}
    assert len({k for k, _ in shown}) > 80
    table = spark.createDataFrame(sorted(shown), "keyword string, text string")
    missed = table.where(~F.contains("text", "keyword") | ~F.col("text").rlike(licenses.PREFILTER))
    assert missed.collect() == []


def brute_labels(text):
    """Labels by every rule over the words, without gates, and by comparing all pairs of matches."""
    norm = " " + " ".join(WORD.findall(text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))) + " "
    found = []
    for rule in licenses.rules():
        for m in re.finditer(f"(?<= ){rule.regex}(?= )", norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), rule.priority, rule.label, rule.base))
    key = lambda m: (m[0], -m[1], -m[2], m[3])
    free = {m for m in found if m[4] or not any(key(o) < key(m) and o[0] <= m[0] and o[1] >= m[1] and o[2] >= m[2] for o in found)}
    return ",".join(sorted({m[3] for m in free}))


def test_labels_against_brute_force(spark):
    r = random.Random(3)
    rules = licenses.rules()
    texts = [" ".join(x for _ in range(r.randint(1, 5)) for x in (example(r.choice(rules).regex, r), r.choice(["and", "the", "", "license", "2.0."]))) for _ in range(150)]
    for text, found in zip(texts, scan(spark, texts), strict=True):
        assert found.labels == brute_labels(text), text


def test_many_matches_in_one_text(spark):
    n = 40_000
    row = scan(spark, ["under the MIT License " * n])[0]
    assert (row.n_base, row.first_word, row.last_word, row.labels) == (n, 0, 4 * (n - 1), "mit")


# Quality rules.


def brute_statistics(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_statistics(spark, docs, texts):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.statistics(docs, "doc_id").collect():
        assert tuple(r[c] for c in columns) == brute_statistics(texts[r.doc_id])
    more = ["a b c d e f g h " * 3, "a " * 9, "x\ny\nx\n\n \n x\n", "# * $ | é 😀", "a b c d e f g h i a b c d e f g h", "\x0b\x0c\r\x1c \x85"]
    rows = quality.statistics(spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string"), "doc_id").collect()
    assert {r.doc_id: tuple(r[c] for c in columns) for r in rows} == {i: brute_statistics(t) for i, t in enumerate(more)}


def test_outliers_and_cases(spark, docs):
    texts = [prose(k, 60 + k % 40) for k in range(300)] + [" ".join(w + "###" for w in prose(k).split()) for k in range(5)] + ["few words", None]
    frame = spark.createDataFrame([(k, t, "en", "s" if k % 2 else None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in quality.quality_rules(frame).collect()}
    assert len(rows) == len(texts)
    assert all(rows[k].kept and not rows[k].base_failed for k in range(300))
    assert not any(rows[k].kept or rows[k].base_failed for k in range(300, 305))
    assert all(rows[k].base_failed and not rows[k].kept for k in (305, 306))
    small = quality.quality_rules(docs).collect()
    assert len(small) == docs.count() and all(r.kept <= (not r.base_failed) for r in small)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_shape_is_the_inverse_factor(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.FEATURES)) @ rng.normal(size=(quality.FEATURES, quality.FEATURES))
    frame = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(quality.FEATURES)]).assign(cell="c", start=0))
    cov = np.cov(x.T, bias=True) + np.diag(quality.FLOORS)
    off = x - x.mean(axis=0)
    expected = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
    shape = quality._shape(frame)
    assert math.isclose(shape.first().logdet, np.linalg.slogdet(cov)[1], abs_tol=1e-9)
    found = quality._distances(frame, shape).toPandas()
    order = np.argsort(x[:, 0])
    assert np.allclose(found.sort_values("x0")["d2"].to_numpy(), expected[order])


def brute_determinant(x, support):
    """The least log determinant of many random starts with concentration steps."""
    rng, best, h = np.random.default_rng(4), math.inf, int(np.ceil(support * len(x)))
    for _ in range(60):
        part = x[rng.choice(len(x), quality.FEATURES + 1, replace=False)]
        last = math.inf
        while True:
            cov = np.cov(part.T, bias=True) + np.diag(quality.FLOORS)
            if len(part) == h:  # not the start
                if np.linalg.slogdet(cov)[1] >= last - 1e-9:
                    break
                last = np.linalg.slogdet(cov)[1]
            off = x - part.mean(axis=0)
            part = x[np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable")[:h]]
        best = min(best, last)
    return best


def test_estimates_reach_the_minimum_determinant(spark):
    rng = np.random.default_rng(2)
    tables = []
    for cell, outlying in (("clean", 0), ("spread", 60), ("lump", 80)):
        x = rng.normal(size=(400, quality.FEATURES)) @ rng.normal(size=(quality.FEATURES, quality.FEATURES))
        x[:outlying] = x[:outlying] * 8 if cell == "spread" else x[:outlying] * 0.1 + 6
        tables.append(pd.DataFrame(x, columns=[f"x{i}" for i in range(quality.FEATURES)]).assign(cell=cell))
    shapes = {r.cell: r.logdet for r in quality.estimates(spark.createDataFrame(pd.concat(tables))).collect()}
    for t in tables:
        assert abs(shapes[t["cell"].iloc[0]] - brute_determinant(t.drop(columns="cell").to_numpy(), quality.SUPPORT)) < 0.05


def test_null_language_is_a_cell_apart_from_the_empty_string(spark):
    rows = [(lang, "s", 30, 150, 0, 0, 0) for lang in (None, "", "en") for _ in range(3)]
    stats = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    assert quality._cells(stats, 1).select("cell").distinct().count() == 3
    assert quality._cells(stats, 100).select("cell").distinct().count() == 1


# Languages.


def test_kneser_ney_sums_to_one():
    counts = pd.DataFrame([("en", g, n) for g, n in (("\x02\x02\x02a", 3), ("\x02\x02ab", 2), ("\x02aba", 1), ("\x02\x02ac", 1), ("\x02ab\x02", 1), ("aba\x02", 1))], columns=["lang", "gram", "n"])
    models = langid.build(counts)
    # the characters that end a string, and one that was never met
    seen = sorted({g[-1] for g in counts["gram"]}) + ["q"]
    for context in ("\x02\x02\x02", "\x02\x02a", "\x02ab", "zzz"):
        total = 0.0
        for c in seen:
            p = models.floor
            codes = [np.array([ord(x)]) for x in context + c]
            for n in range(1, langid.ORDER + 1):
                window = codes[langid.ORDER - n :]
                p = p * models._look(models.contexts[n - 1], models.weights[n - 1], langid.gram_hash(window[:-1]) if n > 1 else np.zeros(1, np.uint64), 1.0)[0, 0]
                p += models._look(models.keys[n - 1], models.given[n - 1], langid.gram_hash(window), 0.0)[0, 0]
            total += p
        assert math.isclose(total, 1)


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0}


def test_few_ids_are_ranked(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 20 = 0, 'de', 'en') AS lang")
    hashed = [(r.h, r.doc_id, r.lang) for r in rows.selectExpr("*", "xxhash64(CAST(doc_id AS STRING)) AS h").collect()]
    found = {(r.lang, r.doc_id) for r in langid.smallest(rows, 300).collect()}
    for lang in ("de", "en"):
        first = sorted(x for x in hashed if x[2] == lang)[:300]
        assert {(lang, d) for _, d, _ in first} <= found
    assert len(found) < 2 * 300 + 50
    assert {r.lang for r in langid.smallest(rows.where("doc_id < 100"), 300).collect()} == {"de", "en"}


def test_language_cases(spark, docs, texts):
    rows = langid.identify(docs).collect()
    nothing = {d for d, t in texts.items() if not any(c.isalpha() for c in t)}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == nothing
    assert all(r.score == 0 and not r.accepted for r in rows if r.doc_id in nothing)
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" for r in unlabelled)
    assert langid.identify(docs.limit(0)).count() == 0


def test_word_scores_do_not_depend_on_their_company():
    counts = pd.DataFrame([("de", g, 2) for g in ("\x02\x02\x02h", "\x02\x02ha", "\x02hau", "haus", "aus\x02")] + [("en", g, 2) for g in ("\x02\x02\x02h", "\x02\x02ho", "\x02hou")], columns=["lang", "gram", "n"])
    models = langid.build(counts)
    together = models.word_scores(["haus", "hou", "éa"])
    assert np.allclose(together, np.vstack([models.word_scores([w]) for w in ("haus", "hou", "éa")]))
    assert together[0, 0] > together[0, 1] and together[1, 1] > together[1, 0]


# Classifier.


def test_sum_of_squares_is_the_sum_over_pairs():
    machine = fm.Machine(np.zeros(fm.STATS), np.ones(fm.STATS))
    machine.w = np.random.default_rng(1).normal(size=len(machine.w))
    stats, distinct = fm.features(pa.array(["a b c a", "", "Water, 12 stone!\nWater"]))
    ids, x, first = machine.rows(stats, distinct)
    scores = machine.scores(ids, x, first)[0]
    for k, (a, b) in enumerate(zip(first, [*first[1:], len(ids)], strict=True)):
        pairs = sum(float(machine.v[ids[i]] @ machine.v[ids[j]]) * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert math.isclose(scores[k], float(machine.w[ids[a:b]] @ x[a:b]) + pairs, rel_tol=1e-6, abs_tol=1e-9)
    assert [len(d) for d in distinct] == [3, 0, 4]


def test_classifier(spark, docs, sf):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = fm.quality_scores(table, labels).join(labels, "doc_id", "left").collect()
    # rows that were never learned from
    good, bad = ([r.score for r in rows if r.held_out and r.quality == q] for q in (1, 0))
    assert len(good) > 5 and len(bad) > 1
    assert len(rows) == table.count() and np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    shown = spark.createDataFrame([(0, 1), (7, 0), (99, 1), (None, 0), (8, None)], "doc_id long, quality int")
    assert fm.quality_scores(docs, shown).count() == docs.count()
    assert {r.score for r in fm.quality_scores(docs, shown.limit(0)).collect()} == {0.5}
    assert fm.quality_scores(docs.limit(0), shown).count() == 0

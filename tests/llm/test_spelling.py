"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillspark.llm import spelling


def brute_counts(rows):
    low = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = brute_counts(rows)
    out, form = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [n, len(others)]
    root = {}
    for w in counts:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n, m, counts[form[w]] if form[w] else None) for w, (n, m) in out.items()}


def found(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, word string, n int")
    return [tuple(r) for r in spelling.variants(frame, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def corpus(seed: int, n: int = 60):
    """Words with misspellings of misspellings, each a tenth as frequent."""
    r = random.Random(seed)
    letters = "abcdeéüßñ÷"
    words = ["".join(r.choice(letters) for _ in range(r.randint(6, 11))) for _ in range(25)]
    pool = []
    for w in words:
        for times in (r.choice((400, 300)), 25, 2, 1):
            pool += [w.upper() if r.random() < 0.1 and w.isascii() else w] * times
            k = r.randrange(len(w))
            w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]))
    r.shuffle(pool)
    step = -(-len(pool) // n)
    return [(k, " 1".join(pool[k * step : (k + 1) * step]) + "\n") for k in range(n)]


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"slice_words": 7, "round_bytes": 64}), (3, {"slice_words": 20, "round_bytes": 200})])
def test_equals_brute_force(spark, seed, more):
    """In one round, and in many of few slices."""
    rows = corpus(seed)
    got, expected = found(spark, rows, **more), brute(rows)
    assert {*got} == expected and len(got) == len(expected)
    assert any(f and r != f for _, f, r, *_ in expected)


def test_cases(spark):
    """Nulls, empty texts, repeated rows, ties, very long words, no words at all."""
    long_word = "abcdefghij" * 20_000
    rows = [(1, None), (2, ""), (None, "variant variant"), (3, "variant"), (3, "variant"), (4, "variamt variamt " * 3), (5, "varianr varianr " * 3), (6, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa"), (7, f"{long_word} {long_word} {long_word[:-1]} {long_word[:-1]}"), (8, "x" * 6 + " ÀÉÎ÷×ÿÿ ÀÉÎ÷×ÿÿ àéî÷×ÿÿ"), (9, "under_score7seventeen seventeen")]
    assert {*found(spark, rows)} == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, "short"), (2, None)]) == []


def test_filters_lose_nothing():
    """Every word of the vocabulary passes, and few others do."""
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, 9).astype(np.uint8)) for _ in range(5000)]
    blocks = spelling._blocks(len(words))
    bits = np.zeros(blocks, np.uint64)
    h = spelling._terms(spelling._matrix(words, 9)).sum(axis=1, dtype=np.uint64)
    x = spelling._mixed(h)
    for k in range(spelling.PROBES):
        np.bitwise_or.at(bits, ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), spelling._bit(x, k))
    filters = spelling.Filters({9: (1, blocks, 0, bits)})
    assert len(filters.holds(9, h)) == len(words) and not len(filters.holds(8, h))
    others = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert len(filters.holds(9, others)) < 1000


def test_hashes_of_edits():
    """The hash of an edited word follows from the word's own."""
    class Every:
        by_length = {6: None, 7: None}

        def holds(self, length, h):
            self.seen = getattr(self, "seen", []) + [h]
            return np.arange(len(h))

    every = Every()
    alphabet = np.frombuffer("abcñ".encode("latin-1"), np.uint8)
    got = list(spelling.edits([b"abcabca"], alphabet, every))
    for (_, others), h in zip(got, every.seen, strict=True):
        assert len({*others}) == len(others)
        assert [int(spelling._terms(spelling._matrix([o], len(o))).sum(dtype=np.uint64)) for o in others] == h.tolist()
    assert {o for _, os in got for o in os if len(o) == 6} == {b"abcabca"[:k] + b"abcabca"[k + 1 :] for k in range(7)}


def test_rounds_hold_every_slice_once():
    chosen = spelling.rounds({7: (3, 10), 8: (1, 1000), 9: (40, 5)}, 400)
    slices = [(k, s) for r in chosen for k, a, b in r for s in range(a, b)]
    assert len(slices) == len({*slices}) == 44
    blocks = {7: 10, 8: 1000, 9: 5}
    assert all(sum(8 * blocks[k] * (b - a) for k, a, b in r) <= 400 or len(r) == 1 for r in chosen)

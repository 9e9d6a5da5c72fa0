"""Hard negatives against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tillspark.llm import negatives


def brute(rows):
    """rows: (vec_id, label, vector) that take part, labels as in the table."""
    good = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if i % 7 == 0:
            label = int(np.fmod(label + 1, 10))
        item = (label, [int(np.floor(256 * float(x))) for x in v])
        if i not in good or item < good[i]:
            good[i] = item
    out = set()
    for a in (i for i in good if i % 100 == 0):
        label, q = good[a]
        scored = sorted((-sum(x * y for x, y in zip(q, good[i][1], strict=True)), i) for i in good if i != a)
        for s, p in [(s, i) for s, i in scored if good[i][0] == label][:5]:
            own = [(n, i) for n, i in scored if good[i][0] != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out |= {(a, p, r, i, -s, -n) for r, (n, i) in enumerate(own, 1)}
    return out


def found(spark, rows):
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], "vec_id long, embedding array<float>, label int, part string, score int")
    return [tuple(r) for r in negatives.hard_negatives(frame).collect()]


def table(seed: int, n: int, width: int = 12, close: int = 0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    v = rng.normal(size=(n, width)) * (0.1 if close else 1) + centres[rng.integers(0, 8, n)]
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    v[: close // 2] = v[0]
    return [(i, int(rng.integers(0, 4)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "close"), [(1, 700, 0), (2, 900, 300), (3, 12, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, n, close):
    """With few rows a cell and many rounds; a third of the rows alike in one case."""
    for name, value in {"CELL_ROWS": 8, "FIRST": 2, "GROWTH": 3, "ANCHORS": 3}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = table(seed, n, close=close)
    got = found(spark, rows)
    assert len(got) == len({*got}) and {*got} == brute(rows)


def test_cases(spark):
    """Nulls, values that aren't finite, ties, repeated rows, other widths, negative scores and labels."""
    rows = table(5, 320)
    tie = rows[3][2]
    rows += [(1000 + k, k % 3, tie) for k in range(30)] + [(100, 9, rows[7][2]), (100, rows[100][1], rows[100][2])]
    rows += [(None, 1, tie), (2001, None, tie), (2002, 1, None), (2003, 1, [None, *tie[1:]]), (2004, 1, [float("nan"), *tie[1:]]), (2005, 1, [float("inf"), *tie[1:]])]
    rows += [(2100, 1, [-x for x in tie]), (2101, -3, tie), (2107, -3, tie)]
    assert {*found(spark, rows)} == brute(rows)
    assert found(spark, []) == []
    short = [(i, label, v[:5] if i % 2 else v) for i, label, v in table(6, 210)]
    assert {*found(spark, short)} == brute([(i, label, [*v, *[0.0] * (12 - len(v))]) for i, label, v in short])
    large = [(0, 1, [1.0, 0.0]), (1, 1, [3e38, 1.0]), (2, 2, [1e38, 0.0]), (3, 2, [0.5, 1.0])]
    assert {*found(spark, large)} == brute([(i, label, [min(x, 32768.0) for x in v]) for i, label, v in large]) != set()


def test_bounds_hold():
    """No row scores more than its cell's sum, and cells come in descending order, each with rows once."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(400, 10)))
    books = (negatives.codebook(x[:, :5], 6), negatives.codebook(x[:, 5:], 6))
    codes = [negatives._squared(p, b).argmin(axis=1) for p, b in zip((x[:, :5], x[:, 5:]), books, strict=True)]
    radii = tuple(np.array([np.sqrt(((p - b[c]) ** 2).sum(axis=1))[c == k].max(initial=0) for k in range(len(b))]) for p, b, c in zip((x[:, :5], x[:, 5:]), books, codes, strict=True))
    counts = np.zeros((6, 6), int)
    np.add.at(counts, tuple(codes), 1)
    index = negatives.Index(books, counts, radii)
    for q in x[:20]:
        visited = list(index.cells(q))
        assert [b for _, b in visited] == sorted((b for _, b in visited), reverse=True)
        assert sorted(c for c, _ in visited) == sorted(np.flatnonzero(counts.ravel()))
        bound = dict(visited)
        assert all(x[k] @ q <= bound[codes[0][k] * 6 + codes[1][k]] for k in range(len(x)))


def test_a_close_cluster_is_certified_early():
    """In separate clusters, an anchor's first cells certify its positives."""
    rng = np.random.default_rng(4)
    centres = np.eye(16) * 4
    x = np.floor(256 * (centres[np.arange(2000) % 16] + rng.normal(size=(2000, 16)) * 0.01))
    books = (negatives.codebook(x[:, :8], 16), negatives.codebook(x[:, 8:], 16))
    codes = [negatives._squared(p, b).argmin(axis=1) for p, b in zip((x[:, :8], x[:, 8:]), books, strict=True)]
    radii = tuple(np.array([np.sqrt(((p - b[c]) ** 2).sum(axis=1))[c == k].max(initial=0) for k in range(len(b))]) for p, b, c in zip((x[:, :8], x[:, 8:]), books, codes, strict=True))
    counts = np.zeros((len(books[0]), len(books[1])), int)
    np.add.at(counts, tuple(codes), 1)
    bounds = [b for _, b in negatives.Index(books, counts, radii).cells(x[0])]
    fifth = np.sort(x @ x[0])[-6]
    assert sum(b >= fifth for b in bounds) <= 3

"""The neighbour search of the near-duplicates against whole comparisons."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillspark.llm import near

PLACES = near.TREES * near.DEPTH


def rows(rng: np.random.Generator, regions: list[int], kinds: int):
    """Signatures in order, of regions in which rows share places with one of a few rows, so that chains form."""
    key = np.repeat(np.arange(len(regions)), regions)
    sig = np.empty((len(key), PLACES), np.uint8)
    for r in range(len(regions)):
        bases = rng.integers(0, 256, (kinds, PLACES))
        at = np.flatnonzero(key == r)
        own = bases[rng.integers(0, kinds, len(at))]
        other = rng.integers(0, 256, own.shape)
        sig[at] = np.where(rng.random(own.shape) < rng.uniform(0.5, 0.9), own, other)
    order = np.lexsort((*sig.T[::-1], key))
    return key[order], sig[order]


def components(n: int, pairs) -> list[int]:
    root = list(range(n))
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


def whole(key, sig):
    return [(i, j) for i in range(len(key)) for j in range(i + 1, len(key)) if key[i] == key[j] and (sig[i] == sig[j]).mean() >= near.LEAST_AGREEMENT]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(1, 14), min_size=1, max_size=4), st.integers(1, 5), st.integers(0, 20))
def test_regions_are_compared_whole(seed, regions, kinds, held):
    """In one batch, and where a batch ends within a region."""
    key, sig = rows(np.random.default_rng(seed), regions, kinds)
    expected = components(len(key), whole(key, sig))
    assert components(len(key), zip(*near.neighbours(key, sig), strict=True)) == expected
    cut = min(held, len(key))
    first, second = near.neighbours(key[:cut], sig[:cut]), near.neighbours(key, sig, cut)
    assert components(len(key), [*zip(*first, strict=True), *zip(*second, strict=True)]) == expected
    found = {*zip(*near.neighbours(key, sig), strict=True)}
    assert found <= {*whole(key, sig)} and {(i, j) for i, j in whole(key, sig) if j == i + 1} <= found


def test_a_row_in_a_chain_still_meets_rows_behind_the_chain():
    """Rows 0 and 4 agree; rows 0 to 3 form a chain."""
    sig = np.zeros((5, PLACES), np.uint8)
    for k in range(4):
        sig[k, : 18 * k] = 10 + k
    sig[4] = np.where(np.arange(PLACES) < 40, sig[0], 99)
    pairs = {*zip(*near.neighbours(np.zeros(5, np.int64), sig), strict=True)}
    assert (0, 4) in pairs and (0, 1) in pairs


@pytest.mark.parametrize("partition", [40, 400])
def test_regions_across_partitions(spark, monkeypatch, partition):
    """A region that range partitions cut is compared as one."""
    monkeypatch.setattr(near, "PARTITION_ROWS", partition)
    rng = np.random.default_rng(3)
    key, sig = rows(rng, [9, 30, 1, 60], 12)
    frame = spark.createDataFrame([(int(d), [int(k)], s.tobytes()) for d, (k, s) in enumerate(zip(key, sig, strict=True))], "doc_id long, keys array<long>, sig binary")
    found = [(r.a, r.b) for r in near.candidates(frame).collect()]
    assert len(found) == len({*found})
    assert components(len(key), found) == components(len(key), whole(key, sig))

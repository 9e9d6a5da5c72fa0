"""Vectorised rolling hashes of byte strings, for words, shingles and fixed-length substrings.

A hash of bytes b0 b1 ... is the sum of VALUE[b_k] * INVERSE**k modulo 2**64, mixed; equal strings have equal
hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))
#: A value per byte, from a fixed generator.
VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and INVERSE**k for k up to ``n``."""
    if len(_powers.get("base", ())) <= n:
        for name, x in (("base", BASE), ("inverse", INVERSE)):
            steps = np.full(n + 1, x, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["base"], _powers["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums by which ``span_hash`` gets the hash of any span of ``data`` (uint8)."""
    inverse = powers(len(data))[1]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(VALUE[data] * inverse[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums) - 1)[0][starts])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and where each text begins (and the last ends)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that separate words: `[\\x20\\x09-\\x0D]`.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of ``data``, and the first word of each text (and one behind the last)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~blank[data]
    turn = np.diff(inside)
    # a text's last word doesn't run on into the next text
    edge = offsets[1:-1]
    edge = np.unique(edge[(edge > 0) & (edge < len(data))])
    joined = edge[(inside[edge] == 1) & (inside[edge + 1] == 1)]
    starts = np.sort(np.concatenate([np.flatnonzero(turn == 1), joined]))
    ends = np.sort(np.concatenate([np.flatnonzero(turn == -1), joined]))
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """``data`` with A-Z in lower case."""
    return _LOWER[data]


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of the ``size``-word shingles of each text, A-Z lower-cased.

    A text of fewer words has one, of all of them; one without words has none.
    """
    data, offsets = flat(texts)
    data = lower(data)
    starts, ends, first = words(data, offsets)
    hashes = span_hash(prefix_sums(data), starts, ends)
    n = max(len(hashes) - size + 1, 0)
    sums = np.zeros(n, np.uint64)
    factor = [_U(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(size)]
    for k in range(size):
        sums += hashes[k : k + n] * factor[k]
    sums = mix(sums)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(sums[a : b - size + 1]))
        elif b > a:
            short = (hashes[a:b] * np.array(factor[: b - a])).sum(keepdims=True) + _U(b - a)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

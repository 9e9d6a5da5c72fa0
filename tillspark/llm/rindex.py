"""A run-length index of a repetitive text: run-compressed Burrows-Wheeler transform with sampled run ends.

``RunIndex`` keeps one entry per run of the transform (its byte, where it starts, how often the byte came
before) and the text positions at the first and last row of each run.  ``statistics`` streams patterns
through it from right to left, all patterns side by side, and gives for every pattern position the length of
the longest match that starts there and a row of the transform whose suffix matches so far.
"""

from __future__ import annotations

import numpy as np


#: Bytes of the first sort's keys; the rest of a key tells zero bytes apart.
HEAD = 6


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, tuple[int, np.ndarray]]:
    """The suffixes of ``text`` (uint8) in order, and ranks for ``equal_prefixes`` of ``length`` bytes.

    The text ends with a zero byte.  Zero bytes end strings: of two of them the one further left is the
    smaller, so that every two suffixes differ no later than at their first zero.  At most 65535 zeros.
    """
    n = len(text)
    zeros = np.cumsum(text == 0)
    padded = np.concatenate([text, np.zeros(HEAD, np.uint8)])
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for k in range(HEAD):
        key = key << np.uint64(8) | np.where(alive, padded[k : k + n], 0).astype(np.uint64)
        alive &= padded[k : k + n] != 0
    # the number of the first zero, where it is within the key
    key = key << np.uint64(16) | np.where(alive, 0, zeros + (text != 0)).astype(np.uint64)
    order = np.argsort(key)
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    done, kept = HEAD, (HEAD, rank)
    while True:
        if done <= length < 2 * done:
            kept = (done, rank.copy())
        # what shares its rank with a neighbour is sorted by the rank behind; the rest has its place
        tied = np.flatnonzero(~fresh | np.concatenate([~fresh[1:], [False]])[:n])
        if not len(tied):
            return order, kept
        part = order[tied]
        key = rank[part].astype(np.uint64) << np.uint64(32) | rank[np.minimum(part + done, n - 1)].astype(np.uint64)
        sort = np.argsort(key)
        part, key = part[sort], key[sort]
        fresh[tied] = np.concatenate([[True], np.diff(key) != 0])
        order[tied] = part
        rank[part] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        done *= 2


def equal_prefixes(order: np.ndarray, kept: tuple[int, np.ndarray], length: int) -> np.ndarray:
    """Whether each suffix of ``order`` has the first ``length`` bytes, none zero, of the one before it."""
    done, rank = kept
    same = np.zeros(len(order), bool)
    if done * 2 <= length:  # all suffixes differ within fewer bytes
        return same
    tail = np.concatenate([rank + 1, np.zeros(length, np.int64)])[length - done :][: len(rank)]
    a, b = order[1:], order[:-1]
    same[1:] = (rank[a] == rank[b]) & (tail[a] == tail[b])
    return same


def eight_bytes(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the last axis on, as one number; zeros behind the end."""
    size = x.shape[-1]
    padded = np.concatenate([x, np.zeros((*x.shape[:-1], 7), np.uint8)], axis=-1)
    out = np.zeros(x.shape, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[..., k : k + size].astype(np.uint64)
    return out


class RunIndex:
    def __init__(self, text: np.ndarray, order: np.ndarray) -> None:
        n = len(text)
        self.words = eight_bytes(np.concatenate([text, [0]]).astype(np.uint8))
        shown = text[order - 1]
        first = np.flatnonzero(np.concatenate([[True], shown[1:] != shown[:-1]])) if n else np.zeros(0, np.int64)
        self.n, self.start, self.byte = n, first, shown[first]
        last = np.concatenate([first[1:], [n]])[: len(first)] - 1
        # the text positions of the suffixes at the run ends
        self.head, self.tail, self.stop = order[first], order[last], last
        size = last - first + 1
        by_byte = np.argsort(self.byte, kind="stable")
        counts = np.bincount(self.byte, weights=size, minlength=256).astype(np.int64)
        below = np.concatenate([[0], np.cumsum(counts)[:-1]])
        before = np.cumsum(size[by_byte]) - size[by_byte]
        #: where the suffixes that a run's rows lead to begin
        self.leads = np.empty(len(first), np.int64)
        self.leads[by_byte] = before
        self.runs_of = np.split(by_byte, np.cumsum(np.bincount(self.byte, minlength=256))[:-1])
        self.present = counts > 0
        assert (below[self.byte[by_byte]] <= before).all()

    def _common(self, at: np.ndarray, words: np.ndarray, row: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the text from ``at`` shares with pattern ``row`` (8-byte ``words``) from ``place``, up to
        ``most``."""
        out = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            i, j = np.minimum(at[live] + out[live], self.n), place[live] + out[live]
            differ = self.words[i] ^ words[row[live], j]
            equal = differ == 0
            some = live[~equal]
            out[some] += (differ[~equal].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            live = live[equal]
            out[live] += 8
            live = live[out[live] < most[live]]
        return np.minimum(out, most)

    def statistics(self, patterns: np.ndarray, lengths: np.ndarray):
        """Yields (place, rows, lengths of the longest matches) for the places of ``patterns`` from right to
        left; patterns end at the right edge of the array, so that a shorter one begins further right."""
        m, width = patterns.shape
        words = eight_bytes(patterns)
        row = np.zeros(m, np.int64)
        size = np.zeros(m, np.int64)
        for place in range(width - 1, -1, -1):
            live = np.flatnonzero(lengths >= width - place)
            c = patterns[live, place]
            run = np.searchsorted(self.start, row[live], "right") - 1
            hit = self.byte[run] == c
            length = size[live] + 1
            lead = self.leads[run] + row[live] - self.start[run]
            for x in np.unique(c[~hit]):
                k = np.flatnonzero(~hit & (c == x))
                runs = self.runs_of[x]
                if not len(runs):
                    lead[k], length[k] = 0, 0
                    continue
                # the nearest runs of this byte above and below: one of them shares the longest prefix
                after = np.searchsorted(runs, run[k])
                above, under = runs[np.maximum(after - 1, 0)], runs[np.minimum(after, len(runs) - 1)]
                pattern, here, most = live[k], np.full(len(k), place + 1), size[live[k]]
                up = np.where(after > 0, self._common(self.tail[above], words, pattern, here, most), -1)
                down = np.where(after < len(runs), self._common(self.head[under], words, pattern, here, most), -1)
                best = up >= down
                chosen = np.where(best, above, under)
                lead[k] = self.leads[chosen] + np.where(best, self.stop[chosen] - self.start[chosen], 0)
                length[k] = np.maximum(up, down) + 1
            row[live], size[live] = lead, length
            yield place, row, size

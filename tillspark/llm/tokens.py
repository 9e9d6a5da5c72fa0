"""Chunk-cached encoding with the ``tokenizers`` library over Arrow arrays.

Web text repeats its words, so a slice of texts is cut into space-delimited chunks, each distinct chunk is
encoded once, and the ids of a text are gathered from those of its chunks.  A chunk is the unit that both
kinds of vocabulary treat independently of its neighbours:

* vocabularies that drop white space: every U+0020 is a boundary;
* byte-level BPE attaches one space to the word behind it.  A space starts a new chunk unless it stands
  inside a run of white space (white space before it, and white space or the end of the text behind it).

New chunks go to the library many at a time, as one text, and its ids are dealt back to them: byte-level ids
by the space that opens each chunk, others by a mark that is put between chunks.

A worker keeps the chunks of the last slices in a bounded store (``CACHE_CHUNKS``); what it forgets is encoded
again, so its size changes no result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of one worker's store, about 40 bytes each.
CACHE_CHUNKS = 500_000
#: Bytes of text that are encoded at once (one longer text still goes whole).
SLICE_BYTES = 4_000_000
#: Chunks longer than this are encoded but not kept.
LONGEST_CACHED = 100
#: Chunks that go to the library as one text.
TOGETHER = 1000

#: White space of the vocabularies' patterns (the Unicode property White_Space).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_INNER_SPACE = re.compile(f"[{SPACES}] (?:[{SPACES}]|\\Z)")
#: Stands between chunks that are encoded together; those that hold it are encoded alone.
MARK = "|"
#: The same in the other library's notation: a chunk whose first character isn't white space.
_OPENS_WITH_WORD = "^[^\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_BOUNDARY = re.compile(f"(?<=[^{SPACES}])(?= )|(?= [^{SPACES}])")


def load(path: str):
    """The tokenizer file at ``path``; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_chars() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_TO_CHARS = str.maketrans(dict(enumerate(byte_chars())))


def as_chars(token: bytes) -> str:
    """The byte-level spelling of a token, which need not be whole UTF-8."""
    return token.decode("latin-1").translate(_TO_CHARS)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a string array of about ``limit`` bytes, without nulls (they become empty)."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield texts.slice(at, to - at)
        at = to


def gathered(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` of the ragged table whose row k is ``flat[ends[k]:ends[k + 1]]``: its values, and its ends."""
    sizes = (ends[1:] - ends[:-1])[rows]
    stops = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(ends[:-1][rows] - stops[:-1], sizes) + np.arange(stops[-1])], stops


class Store:
    """The ids of distinct chunks: ``flat[ends[k]:ends[k + 1]]`` for chunk k."""

    def __init__(self, encode) -> None:
        self.encode, self.now = encode, 0
        self._keep(pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64))

    def _keep(self, chunks: pa.Array, flat: np.ndarray, ends: np.ndarray, used: np.ndarray) -> None:
        self.chunks, self.flat, self.ends, self.used = chunks, flat, ends, used

    def rows(self, wanted: pa.Array) -> np.ndarray:
        """The number of each of the distinct chunks ``wanted``; new ones are encoded."""
        wanted = wanted.cast(pa.large_string())
        at = pc.index_in(wanted, value_set=self.chunks)
        rows = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            flat, ends = self.encode(new := wanted.filter(at.is_null()))
            rows[rows < 0] = len(self.chunks) + np.arange(len(new))
            used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self._keep(pa.concat_arrays([self.chunks, new]), np.concatenate([self.flat, flat]), np.concatenate([self.ends, self.ends[-1] + ends[1:]]), used)
        self.used[rows] = self.now
        return rows

    def trim(self) -> None:
        """Forgets long chunks, and those not met for longest; numbers that were given are no longer valid."""
        self.now += 1
        long = pc.binary_length(self.chunks).to_numpy() > LONGEST_CACHED
        if len(self.chunks) > CACHE_CHUNKS or long.any():
            keep = np.flatnonzero(~long)
            if len(keep) > CACHE_CHUNKS:
                keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: CACHE_CHUNKS // 2]])
            self._keep(self.chunks.take(pa.array(keep)), *gathered(self.flat, self.ends, keep), self.used[keep])


class IdEncoder:
    """Ids of whole texts under a ``tokenizers`` tokenizer.

    ``byte_level`` says which rule above cuts texts into chunks.  ``encode`` takes a string array and
    yields ``(ids, ends)`` per slice: all ids of the slice's texts, and where each text's ids end.
    """

    def __init__(self, tokenizer, byte_level: bool) -> None:
        self.tokenizer, self.byte_level = tokenizer, byte_level
        #: Words; in byte-level vocabularies without the space before them, and apart from them other chunks.
        self.words, self.others = Store(self._together), Store(self._alone)
        vocabulary = tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(_TO_CHARS[32])]] = True
        self.mark = tokenizer.encode(MARK, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in slices(texts):
            yield self._slice(part)

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of one text after the other."""
        for ids, ends in self.encode(texts):
            yield from np.split(ids, ends[:-1])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        words = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        coded = words.dictionary_encode()
        rows = self.words.rows(coded.dictionary)[coded.indices.to_numpy()]
        flat, ends = self.words.flat, self.words.ends
        if self.byte_level:
            # all but a text's first chunk have a space before them
            rows, starts, chunks = self._uneven(texts, words, rows, starts)
            more = self.others.rows(chunks.dictionary)[chunks.indices.to_numpy()]
            rows[rows < 0] = len(ends) - 1 + more
            flat, ends = np.concatenate([flat, self.others.flat]), np.concatenate([ends, ends[-1] + self.others.ends[1:]])
        ids, stops = gathered(flat, ends, rows)
        self.words.trim()
        self.others.trim()
        return ids, stops[starts[1:]]

    def _uneven(self, texts, words, rows, starts):
        """``rows`` with -1 for chunks that aren't a space and a word, and those chunks in turn: the first of
        each text, and all of texts with runs of white space around a space."""
        rows[starts[:-1]] = -1
        firsts = words.take(pa.array(starts[:-1]))
        odd = [i for i, t in enumerate(texts.to_pylist()) if _INNER_SPACE.search(t)]
        if not odd:
            return rows, starts, firsts.dictionary_encode()
        parts, chunks = np.split(rows, starts[1:-1]), [[x] for x in firsts.to_pylist()]
        for i in odd:
            chunks[i] = _BOUNDARY.split(texts[i].as_py())
            parts[i] = np.full(len(chunks[i]), -1)
        flat = pa.array([x for own in chunks for x in own], pa.large_string())
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)]), flat.dictionary_encode()

    def _alone(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(chunks.to_pylist(), add_special_tokens=False)
        ids = [e.ids for e in found]
        return np.array([i for x in ids for i in x], np.uint32), np.cumsum([0, *map(len, ids)])

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` (with a space before each, if byte-level), many words in one text."""
        if self.byte_level:
            fit = pc.match_substring_regex(words, _OPENS_WITH_WORD)
        else:
            fit = pc.invert(pc.match_substring(words, MARK)) if len(self.mark) == 1 else pc.is_null(words)
        fit = fit.to_numpy(zero_copy_only=False)
        regular = words.filter(pa.array(fit))
        edges = np.unique([*range(0, len(regular), TOGETHER), len(regular)])
        groups = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), regular)
        between = pa.scalar(" " if self.byte_level else f" {MARK} ", pa.large_string())
        joined = pc.binary_join(groups, between).to_pylist() if len(regular) else []
        joined = [f" {x}" if self.byte_level else f"{x} {MARK}" for x in joined]
        flat, _ = self._alone(pa.array(joined, pa.large_string()))
        if self.byte_level:
            ends = np.append(np.flatnonzero(self.opens[flat]), len(flat))
        else:
            marks = flat == self.mark[0] if len(self.mark) == 1 else np.zeros(0, bool)
            ends = np.append(0, np.flatnonzero(marks) - np.arange(np.count_nonzero(marks)))
            flat = flat[~marks]
        if len(ends) != len(regular) + 1:  # a vocabulary whose ids don't show where chunks begin
            fit[:] = False
            flat, ends = flat[:0], np.zeros(1, np.int64)
        if fit.all():
            return flat, ends
        space = " " if self.byte_level else ""
        more, stops = self._alone(pa.array([space + x for x in words.filter(pa.array(~fit)).to_pylist()], pa.large_string()))
        place = np.empty(len(words), np.int64)
        place[fit], place[~fit] = np.arange(len(ends) - 1), len(ends) - 1 + np.arange(len(stops) - 1)
        return gathered(np.concatenate([flat, more]), np.concatenate([ends, ends[-1] + stops[1:]]), place)

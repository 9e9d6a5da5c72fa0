"""Operator 3: byte-level BPE encoding and decoding from a rank file.

A rank file lists byte strings by merge rank.  ``tokenizer`` builds a ``tokenizers`` model with the same
results as rank merging: every way to cut a token into two ranked tokens is a merge, ordered by the rank of
what it makes, and a pre-token that is itself a token is taken whole.  Encoding runs over Arrow batches with
bytes as printable characters; decoding maps ids back to bytes, so that a character split over several
tokens is whole again.

Cases: a null or empty text has no ids and decodes to no bytes; ids outside the vocabulary raise; repeated
rows are coded alike; null ids pass through; a text of any length is coded whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import IdEncoder, as_chars

_coders: dict[tuple[str, str], tuple[IdEncoder, pa.Array]] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def tokenizer(ranks: dict[bytes, int], pattern: str):
    """A ``tokenizers`` tokenizer for a rank table and the pattern that cuts text before the merges."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = {token: as_chars(token) for token in ranks}
    merges = [
        (chars[token[:i]], chars[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = models.BPE(vocab={chars[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    cut = pre_tokenizers.Split(Regex(pattern), "isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def byte_table(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id; ids without a token are null."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def decode_ids(table: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes that ``ids`` stand for, and where each id's bytes end."""
    found = table.take(pa.array(ids.astype(np.int64)))
    if found.null_count:
        raise ValueError("ids without a token")
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
    data = found.buffers()[2]
    return (data.to_pybytes()[ends[0] : ends[-1]] if data and len(found) else b""), ends[1:] - ends[0]


def char_spans(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each id, and the one behind its last: ids within one character share it."""
    raw = np.frombuffer(data, np.uint8)
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends.astype(np.int64)
    inside = np.concatenate([(raw & 0xC0) == 0x80, [False]])[starts] if len(ends) else np.zeros(0, bool)
    return begun[starts] - inside, begun[ends.astype(np.int64)]


def _coder(path: str, pattern: str) -> tuple[IdEncoder, pa.Array]:
    if (path, pattern) not in _coders:
        ranks = read_ranks(path)
        _coders[path, pattern] = IdEncoder(tokenizer(ranks, pattern), byte_level=True), byte_table(ranks)
    return _coders[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, spans: bool = False, decode: bool = False) -> DataFrame:
    """doc_id and ids of each whole text; with ``spans`` the characters of each id (starts, ends); with
    ``decode`` the bytes that the ids decode to."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", ints)])
    for name in ("starts", "ends") if spans else ():
        schema = schema.add(name, ints)
    if decode:
        schema = schema.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = _coder(ranks, pattern)
        for batch in batches:
            at = 0
            for ids, ends in enc.encode(batch.column(1)):
                doc_ids = batch.column(0).slice(at, len(ends))
                at += len(ends)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns = [doc_ids, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))]
                if spans or decode:
                    data, stops = decode_ids(table, ids)
                    byte_ends = np.concatenate([[0], stops])[np.concatenate([[0], ends])]
                if spans:
                    found = [char_spans(data[a:b], stops[i:j] - a) for a, b, i, j in zip(byte_ends, byte_ends[1:], [0, *ends], ends, strict=False)]
                    for k in (0, 1):
                        flat = np.concatenate([x[k] for x in found]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
                if decode:
                    columns.append(pa.array([data[a:b] for a, b in zip(byte_ends, byte_ends[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) and text (bytes that are no UTF-8 replaced) of rows with ids."""
    schema = "doc_id long, decoded binary, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _coder(ranks, pattern)[1]
        for batch in batches:
            rows = [decode_ids(table, np.array(x or [], np.int64))[0] for x in batch.column(1).to_pylist()]
            texts = [x.decode("utf-8", "replace") for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "decoded", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, schema)

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillspark.llm import byte_bpe, idfile, packing, tokens
from tillspark.llm.queries import vocabulary

TEXT = st.text(alphabet=st.sampled_from(list(" \n\t\x0b\x1c\x85 　abcthesTHE'éßñ漢😀12٣.,!*_<|endoftext|>́")), max_size=40)
WORD, BYTE, RANKS = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("path", "byte_level"), [(WORD, False), (BYTE, True)])
def test_chunks_give_the_ids_of_whole_texts(path, byte_level, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 60)
    tokenizer = tokens.load(path)
    encoder = tokens.IdEncoder(tokenizer, byte_level)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(TEXT, st.text(max_size=20), st.none()), min_size=1, max_size=6))
    def same(texts):
        found = [x.tolist() for x in encoder.texts(pa.array(texts, pa.string()))]
        assert found == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    same()


def test_ranks_give_the_ids_of_the_rank_library(reference):
    ranks = byte_bpe.read_ranks(RANKS)
    encoder, table = tokens.IdEncoder(byte_bpe.tokenizer(ranks, public_tokenizers.PATTERN), True), byte_bpe.byte_table(ranks)

    @settings(max_examples=200, deadline=None)
    @given(st.one_of(TEXT, st.text(max_size=30)))
    def same(text):
        ids = next(encoder.texts(pa.array([text])))
        assert ids.tolist() == reference.encode_ordinary(text)
        data, ends = byte_bpe.decode_ids(table, ids)
        assert data == text.encode()
        first, last = byte_bpe.char_spans(data, ends)
        for a, b, i in zip(first, last, ids, strict=True):
            assert reference.decode_single_token_bytes(int(i)) in text[a:b].encode()

    same()


def test_byte_bpe_over_a_table(docs, texts, reference):
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, spans=True, decode=True).collect()
    assert {r.doc_id: r.ids for r in coded} == {d: reference.encode_ordinary(t) for d, t in texts.items()}
    assert all(r.decoded == texts[r.doc_id].encode() and len(r.starts) == len(r.ends) == len(r.ids) for r in coded)
    frame = docs.sparkSession.createDataFrame([(1, reference.encode_ordinary("😀")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in byte_bpe.decode(frame, RANKS, public_tokenizers.PATTERN).collect()] == ["�", ""]
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op3_query(spark, sf, reference):
    from tillspark.llm.queries import op3_byte_level_bpe

    found = {r.doc_id: r for r in op3_byte_level_bpe(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = reference.encode_ordinary(row.text)
        got = found[row.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def check_packing(rows, capacity):
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_packing(docs, texts):
    tokenizer = tokens.load(WORD)
    cut = packing.pieces(docs, WORD, 64, with_ids=True)
    rows = packing.pack(cut, 64).collect()
    n = check_packing(rows, 64)
    assert n <= 1.02 * sum(r.length for r in rows) / 64 + 1
    for doc, text in texts.items():
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert [i for r in own for i in r.ids] == ids
        assert all(r.start == 64 * r.piece and r.length == len(r.ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert all(r.length == 64 for r in own[:-1])
    whole = packing.sequences(docs.sparkSession.createDataFrame(rows))
    assert sum(len(r.ids) for r in whole.collect()) == sum(r.length for r in rows)
    assert packing.pack(packing.pieces(docs.limit(0), WORD)).count() == 0


def test_packing_in_several_rounds(spark):
    lengths = [(i, 0, 1 + (i * 37) % 64) for i in range(600)]
    frame = spark.createDataFrame(lengths + lengths[:3], "doc_id long, piece int, length long")
    rows = packing.pack(frame, 64, shard_pieces=100, slack=0).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((a, c) for a, _, c in lengths + lengths[:3])
    assert check_packing(rows, 64) <= 1.02 * sum(r.length for r in rows) / 64 + 1


def test_packing_without_ids_and_of_pieces_that_do_not_combine(spark):
    rows = [(None, 0, 3 + k % 5) for k in range(90)] + [(k, 0, 40) for k in range(200)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 64, shard_pieces=50, slack=0).collect()
    assert len(packed) == len(rows) and 200 <= check_packing(packed, 64) <= 204


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_pack_lengths_property(lengths):
    x = np.array(lengths, np.int64)
    bins, fill = packing.pack_lengths(x, 40)
    used = np.bincount(bins, weights=x) if len(x) else np.zeros(0)
    assert (used <= 40).all() and (len(x) == 0 or (used[bins] == fill).all())
    # no two bins could be one
    assert sum(sorted(used[used > 0])[:2]) > 40 or np.count_nonzero(used) < 2


def test_local_search_saves_bins():
    packed = packing.Bins(10)
    packed.bins, packed.fill = [[6, 1], [5, 2], [3, 3]], [7, 7, 6]
    packed.improve()
    assert sum(f > 0 for f in packed.fill) == 2 and sorted(x for b in packed.bins for x in b) == [1, 2, 3, 3, 5, 6]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(5, 12))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids)
    counts = np.bincount(ids, minlength=301)
    if np.count_nonzero(counts) > 1 << limit:
        return
    lengths = idfile.code_lengths(counts, limit)
    assert (lengths[counts > 0] > 0).all() and lengths.max() <= limit
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    stream, offsets = idfile.put_bits(ids, idfile.canonical(lengths), lengths, 16)
    assert (idfile.get_bits(stream, offsets, len(ids), idfile.decoding_table(lengths, limit), 16, limit) == ids).all()


def test_huffman_is_optimal_without_a_tight_limit():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34])
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        heapq.heappush(heap, x := heapq.heappop(heap) + heapq.heappop(heap))
        total += x
    assert (counts * idfile.code_lengths(counts)).sum() == total


def test_id_files(docs, texts, tmp_path):
    tokenizer, spark = tokens.load(BYTE), docs.sparkSession
    idfile.write(docs.repartition(3), str(tmp_path / "ids"), BYTE)
    rows = sorted(idfile.read(spark, str(tmp_path / "ids")).withColumn("crc", F.crc32("ids")).collect(), key=lambda r: r.doc_id)
    start = 0
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids), r.crc) == (start, len(ids), raw, zlib.crc32(raw))
        start += len(ids)
    assert len(rows) == len(texts)
    idfile.write(docs.limit(0), str(tmp_path / "none"), BYTE)
    assert idfile.read(spark, str(tmp_path / "none")).count() == 0

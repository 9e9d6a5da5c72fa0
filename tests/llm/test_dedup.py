from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillspark.llm import exact, near, rindex, suffix
from tillspark.llm.components import connected_components
from tillspark.llm.hashing import shingle_sets

from .conftest import prose

BLANK = re.compile("[\x20\x09-\x0d]")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Exact copies.


def brute_exact(texts):
    groups: dict[str, list] = {}
    for d, t in texts.items():
        groups.setdefault(BLANK.sub("", t), []).append((-len(t), d))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, d in members:
            out[d] = (keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(docs, texts, bits):
    """With digests of 4 bits different texts meet, and only the check of full bytes tells them apart."""
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(docs, bits).collect()}
    assert found == brute_exact(texts)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup_of_repeated_rows_and_none(spark, bits):
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "a  b")], "doc_id long, text string")
    rows = exact.exact_dedup(twice, bits).collect()
    assert [r.keep_id for r in rows] == [2] * 4 and sorted(r.kept for r in rows) == [False, False, False, True]
    # as many texts as digests of four bits, so that some meet
    more = [(k // 2, f"text {k // 2}") for k in range(40)] + [(None, "x"), (None, "x"), (None, None)]
    rows = exact.exact_dedup(spark.createDataFrame(more, "doc_id long, text string"), bits).collect()
    assert sorted(r.doc_id for r in rows if r.kept and r.doc_id is not None) == list(range(20))
    assert sorted((r.group_size, r.kept) for r in rows if r.doc_id is None) == [(1, True), (2, False), (2, True)]
    assert exact.exact_dedup(twice.limit(0), bits).count() == 0


def test_later_arrivals_meet_old_state(spark, docs, texts, tmp_path):
    before = spark.conf.getAll
    first, second = docs.where("doc_id < 8"), docs.where("doc_id >= 8")
    found = exact.exact_dedup(first, state=str(tmp_path / "state"))
    assert {r.doc_id: r.keep_id for r in found.collect()} == {d: x[0] for d, x in brute_exact({d: t for d, t in texts.items() if d < 8}).items()}
    for part, expected in ((second, brute_exact(texts)), (second.limit(0), brute_exact(texts))):
        found = exact.exact_dedup(part, state=str(tmp_path / "state")).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == expected
    assert spark.conf.getAll == before


def test_exact_stream_goes_on_over_several_batches(spark, docs, tmp_path):
    path = str(tmp_path / "landing")
    landing = exact.arrivals(docs.repartition(4), path)
    groups = exact.exact_groups(landing, path, files_per_batch=1)
    assert {r.digest: r.group_size for r in groups.collect()} == {r.digest: r["count"] for r in landing.groupBy("digest").count().collect()}


# Near copies.


def brute_sets(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for d, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", t.translate(low)) if x]
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_near(texts):
    sets = brute_sets(texts)
    root = {d: d for d in texts}
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d], root[d] == d) for d in texts}


def near_of(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df, **more).collect()}


def test_near_duplicates(docs, texts):
    assert near_of(docs) == brute_near(texts)
    assert near_of(docs.limit(0)) == {}


def edited(seed: int, text: str, edits: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randint(0, 99999)}"
    return " ".join(words)


def test_an_arrival_that_is_repeated_counts_once(spark, docs, texts, tmp_path):
    """A call fails after landing, or while it lands; called again with its number, it gives the same."""
    state = str(tmp_path / "state")
    half = docs.where("doc_id < 8")
    exact.arrivals(half, f"{state}/landing", arrival=0)
    expected = sorted(map(tuple, exact.exact_dedup(half).collect()), key=str)
    for _ in range(2):
        assert sorted(map(tuple, exact.exact_dedup(half, state=state, arrival=0).collect()), key=str) == expected
    # the second arrival is cut off before it is noted
    landing = spark.read.parquet(f"{state}/landing").drop("arrival").limit(3)
    landing.write.parquet(f"{state}/landing/arrival=1")
    got = exact.exact_dedup(docs.where("doc_id >= 8"), state=state, arrival=1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, exact.exact_dedup(docs).collect()), key=str)


@pytest.mark.parametrize("limit", [near.CLUSTER_SHINGLES, 100])
def test_near_duplicates_in_dense_groups(spark, limit):
    """Groups of copies that are linked with their base, and not always with each other."""
    base = [prose(s, 150) for s in range(4)]
    texts = [*base, *(edited(k, base[k % 4], 3 + k % 2) for k in range(120)), *(prose(100 + k) for k in range(30)), "", "one two"]
    assert near_of(frame(spark, texts), cluster_shingles=limit) == brute_near(dict(enumerate(texts)))


def test_near_duplicates_without_id_or_with_one_twice(spark):
    text = prose(1)
    rows = [(5, text), (5, prose(2)), (7, text + " end"), (None, text), (None, None), (9, prose(2)), (9, prose(2))]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None) == [(0, None, True), (len(text.split()) - 4, None, True)]
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id is not None} == {(5, 5), (7, 5), (9, 5)}


def test_pairs_amid_texts_with_a_common_passage(spark):
    """A dense region: all texts share a passage (not enough to be linked), a few have a partner at 0.75 or more."""
    passage = prose(3, 60)
    texts = [f"{prose(1000 + k, 40)} {passage} {prose(5000 + k, 40)}" for k in range(600)]
    texts += [edited(k, texts[k], 2) for k in range(60)]
    assert near_of(frame(spark, texts)) == brute_near(dict(enumerate(texts)))


def test_signature_bytes_tell_long_texts_apart():
    rng = np.random.default_rng(5)
    for n in (50, 1000, 20_000):
        a, b = (np.frombuffer(near.signature_bytes(near._signed(rng.integers(0, 1 << 63, n).astype(np.uint64))), np.uint8) for _ in range(2))
        assert (a == b).mean() < 0.1


def test_star_of_copies_in_a_large_cluster(spark):
    """Copies that are linked through their base alone, more than its candidates."""
    base = prose(7, 150)
    texts = [base, *(edited(k, base, 4) for k in range(260))]
    expected = brute_near(dict(enumerate(texts)))
    assert sum(root == 0 for _, root, _ in expected.values()) > 193
    assert near_of(frame(spark, texts), cluster_shingles=2000) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=12), min_size=2, max_size=14))
def test_cluster_finds_every_link(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    found = near.Cluster(arrays).components()
    assert all((found[a] == found[b]) == (root[a] == root[b]) for a in range(len(sets)) for b in range(a))


def test_shingle_sets(texts):
    found = shingle_sets(pa.array(list(texts.values())))
    assert [len(s) for s in found] == [len(s) for s in brute_sets(texts).values()]
    assert len(shingle_sets(pa.array(["a b c d e", "A B c d E", "a b c d"]))[0]) == 1


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 50), (70, 60)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated substrings.


def brute_spans(texts, length):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[d] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def spans_of(df, **more):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix.remove_repeats(df, **more).collect()}


@pytest.mark.parametrize("group", [suffix.GROUP_CONTEXTS, 3, 1])
def test_remove_repeats(docs, texts, group):
    assert spans_of(docs, group_contexts=group) == brute_spans(texts, 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_repeats_from_repetitive_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix, "INDEX_BYTES", 2000)
    r = random.Random(seed)
    blocks = ["".join(r.choices("abcé", k=r.randint(10, 90))) for _ in range(6)]
    texts = ["".join(r.choices(blocks, k=r.randint(0, 9))) for _ in range(40)] + ["a" * 300, "ab" * 90, "x" * 31, "x" * 29]
    assert spans_of(frame(spark, texts), length=30) == brute_spans(dict(enumerate(texts)), 30)


def test_remove_repeats_cases(spark):
    text = prose(1)
    rows = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (None, text, "de"), (2, "é" * 200, "fr")], "doc_id long, text string, lang string")
    found = suffix.remove_repeats(rows, carry=("lang",)).collect()
    assert sorted((r.n_removed, r.lang) for r in found) == [(0, "de"), (0, "en"), (0, "en"), (398, "fr")]
    assert suffix.remove_repeats(rows.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(2 + x % 3 for x in b)), min_size=1, max_size=8, unique=True), st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(2 + x % 4 for x in b)), min_size=1, max_size=4))
def test_run_index(parts, others):
    raw = b"".join(p + b"\0" for p in parts)
    text = np.frombuffer(raw, np.uint8)
    order, kept = rindex.suffix_order(text, 8)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : raw.index(0, i)], i))
    same = rindex.equal_prefixes(order, kept, 8)
    for k in range(1, len(order)):
        x, y = raw[order[k] : order[k] + 8], raw[order[k - 1] : order[k - 1] + 8]
        assert same[k] == (x == y and len(x) == 8 and 0 not in x)
    patterns = others + parts
    width = max(map(len, patterns))
    table = np.zeros((len(patterns), width), np.uint8)
    for i, p in enumerate(patterns):
        table[i, width - len(p) :] = np.frombuffer(p, np.uint8)
    for place, row, size in rindex.RunIndex(text, order).statistics(table, np.array([len(p) for p in patterns])):
        for i, p in enumerate(patterns):
            rest = p[place - width + len(p) :] if place >= width - len(p) else b""
            if rest:
                assert size[i] == max(n for n in range(len(rest) + 1) if rest[:n] in raw)
                assert raw[order[row[i]] :].startswith(rest[: size[i]])

"""Personal data: base spans, the field's recursions and decoding against brute force; held-out entities."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillspark.llm import pii

WORDS = "water stone river light cloud Äpfel niño été under token".split()
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    """The contract's expressions as they are."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


PIECES = st.sampled_from(["a", "Z9", "é", "@", ".", "-", "_", "%", "+", " ", "(", ")", "1", "25", "255", "256", "0007", "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "x@y.zz", "\n", "+1 (887) 555-1668", "="])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def field():
    return pii.fit(list(pii.made(WORDS, 1500)))


def test_made_entities_that_were_not_learned(field):
    """Held out: nearly all entities exactly, and no span on a look-alike."""
    wanted, right, given_spans = 0, 0, 0
    for text, spans in pii.made(WORDS, 1500, seed=77):
        found = pii.spans(text, field, [])
        wanted, right, given_spans = wanted + len(spans), right + len({*spans} & {*found}), given_spans + len(found)
    assert right >= 0.95 * wanted and right >= 0.98 * given_spans


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 4), st.floats(-4, 4)), max_size=9, unique_by=lambda c: (c[0], c[1])))
def test_sum_over_all_segmentations(rows):
    ends, scores = [(s, s + n) for s, n, _ in rows], [x for *_, x in rows]
    total, seen = 0.0, np.zeros(len(rows))
    for k in range(len(rows) + 1):
        for chosen in itertools.combinations(range(len(rows)), k):
            spans = sorted(ends[c] for c in chosen)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(spans)):
                weight = math.exp(sum(scores[c] for c in chosen))
                total += weight
                seen[list(chosen)] += weight
    whole, found = pii.marginals(ends, scores)
    assert math.isclose(whole, math.log(total), abs_tol=1e-9) and np.allclose(found, seen / total)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5), st.integers(0, 6), st.integers(1, 50)), max_size=8), st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4)), max_size=2))
def test_decoding_is_the_best_segmentation(rows, base):
    base = [(pii.BASE_KINDS[k], s, s + n) for k, (s, n) in enumerate(base)]
    found = [(s, s + n, kind, float(x)) for s, n, kind, x in rows]
    best = 0.0
    free = [c for c in found if all(c[1] <= s or e <= c[0] for _, s, e in base)]
    for k in range(len(free) + 1):
        for chosen in itertools.combinations(free, k):
            spans = sorted(c[:2] for c in chosen)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(spans)):
                best = max(best, sum(c[3] for c in chosen))
    got = pii.decode(base, found)
    assert [x for x in got if x in base] == sorted(base, key=lambda x: (pii.KINDS.index(x[0]), x[1])) or len(base) > 1
    own = list(got)
    for b in base:
        own.remove(b)
    assert sum(max(x for s, e, kind, x in free if (pii.KINDS[kind], s, e) == o) for o in own) == best


def test_likelihood_gradient():
    """Fitting raises the likelihood of what it is fitted on: the gold candidates become the likely ones."""
    data = list(pii.made(WORDS, 400, seed=5))
    field = pii.fit(data)
    right = total = 0
    for text, spans in data:
        for a, b in pii.chains(text):
            own = list(pii.candidates(text, a, b))
            if own:
                scores = field.scores(own)
                joint = np.log(np.exp(scores).sum(axis=1))
                seen = pii.marginals([(c.start, c.end) for c in own], joint.tolist())[1]
                for c, p, k in zip(own, seen, scores.argmax(axis=1), strict=True):
                    total += 1
                    gold = (pii.KINDS[k], c.start, c.end) in spans
                    right += (p > 0.5) == any((c.start, c.end) == (s, e) for _, s, e in spans) and (p <= 0.5 or gold)
    assert right >= 0.98 * total


def test_method_adds_what_base_misses(field):
    text = "token = \"9885103314b39ed955fd8ac9efa74c6fd87b\" and +1 (269) 555-3296 4524132264652876 then iban: DE89370400440532013000, 2024-03-01 12:30:45 x"
    assert pii.base_spans(text) == []
    assert [(k, text[s:e]) for k, s, e in pii.spans(text, field)] == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296"), ("secret", "9885103314b39ed955fd8ac9efa74c6fd87b"), ("iban", "DE89370400440532013000")]


def test_long_texts_take_time_in_proportion(field):
    """Megabytes without a space, of digits, points or dashes, and an entity behind them."""
    for part, size in (("a", 2_000_000), ("9", 2_000_000), ("1.", 500_000), ("1-", 500_000), ("a.", 500_000), ("@", 500_000), ("+1", 500_000), ("1 ", 50_000)):
        text = part * (size // len(part)) + " x@y.example.com"
        began = time.time()
        assert ("email", len(text) - 15, len(text)) in pii.spans(text, field)
        assert time.time() - began < 120, part


def test_query_rows(spark, docs, texts):
    rows = [(20, "x@y.zz and 10.0.0.1", "en"), (21, None, "en"), (20, "x@y.zz and 10.0.0.1", "en"), (None, 'é password="a1b2c3d4e5f6a7b8c9" +44 20 7946 0958 4111 1111 1111 1111', None)]
    frame = docs.select("doc_id", "text", "lang", "label").unionByName(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, label string"))
    found = pii.personal_data(frame.withColumn("spans", frame.label)).collect()
    assert len(found) == len(texts) + 4
    by = {r.doc_id: r for r in found}
    assert by[21].spans == "" and by[21].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[20].spans == "email:0:6,ip:11:19" and (by[20].n_email, by[20].n_ip, by[20].n_card, by[20].n_phone) == (1, 1, 0, 0)
    text = rows[3][1]
    for d, t in [*texts.items(), (None, text)]:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(t))
        assert by[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert {*base.split(",")} - {""} <= {*by[d].spans.split(",")}
    assert "secret:12:30" in by[None].spans
    assert pii.personal_data(docs.limit(0)).collect() == []

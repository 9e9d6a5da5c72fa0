from __future__ import annotations

import pytest

import corpus_pipeline
from tillspark.llm import tokens
from tillspark.llm.queries import vocabulary

from .test_dedup import brute_exact, brute_near, brute_spans
from .test_rules import brute_statistics


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows after each stage, by its name."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_each_stage_against_brute_force(stages):
    columns = list(corpus_pipeline.COLUMNS)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(stages[name][0].__fields__) == columns
    before, good = texts(stages["input"]), texts(stages["quality rules"])
    counts = {d: brute_statistics(t) for d, t in before.items()}
    failed = {d for d, (n, _, _, _, repeat) in counts.items() if n < 20 or 100 * repeat > 30 * n}
    assert not failed & good.keys() and len(good) >= 0.85 * (len(before) - len(failed))
    single = texts(stages["exact dedup"])
    assert single.keys() == {d for d, x in brute_exact(good).items() if x[2]}
    apart = texts(stages["MinHash near-dedup"])
    assert apart.keys() == {d for d, x in brute_near(single).items() if x[2]}
    cut = {r.doc_id: r for r in stages["suffix-array dedup"]}
    spans = brute_spans(apart, 100)
    assert cut.keys() == apart.keys()
    assert all(r.n_chars == len(r.text) and spans[d][0] - spans[d][1] - 6 <= len(r.text.encode()) <= spans[d][0] - spans[d][1] for d, r in cut.items())
    tokenizer = tokens.load(vocabulary("word_bpe_49k.json"))
    packed: dict[int, int] = {}
    filled: dict[int, int] = {}
    for r in stages["best-fit packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert packed == {d: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in cut.items()}
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1


def test_run_equals_its_stages(spark, sf, stages):
    found = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert found == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages["best-fit packing"])


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0

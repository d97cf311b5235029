"""The pipeline against its stages' brute-force rules, on the table that each stage really had."""

import corpus_pipeline
from sparkvista.llm.common import materialize, table
from tests.llm.test_decontamination import items_in
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        kept[name] = (before, docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    toxic = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid"}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    few = lambda t: len(toxic & set(t.lower().replace(",", " ").replace(".", " ").split()))
    assert all(few(r.text) == 0 or r.doc_id in gone for r in before if few(r.text) > 3)
    assert len(after) >= 0.85 * len(before)
    before, after = kept["ngram_jaccard_join"]
    groups = brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({g if n else i for i, g, n in groups})
    before, after = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not items_in(r.text, items))
    before, after = kept["mixing_sources"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > len(before)
    before, after = kept["sharding"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted((r.doc_id, r.text) for r in before)


def test_run_is_the_stages(spark):
    a, b = (sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "empty")
        assert docs.count() == 0

"""The pipeline's stages, one after the other, each against what it was given."""

from __future__ import annotations

import brute
import corpus_pipeline
from prefdeck.llm.common import stored


def test_stages_on_odd_rows(spark, sf_dir, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, sf_dir))
        assert docs.columns == before.columns and docs.schema == odd_docs.schema, name
        if name == "simhash_near_dedup":
            rows = [(i, r.text) for i, r in enumerate(before.collect())]
            groups = {c for _, _, c in brute.near_groups(rows)}
            assert docs.count() == len(groups)
        if name == "suffix_array_dedup":
            want = brute.repeats([(r.doc_id, r.text) for r in before.collect()])
            assert sum(len((r.text or "").encode()) for r in docs.collect()) <= sum(n - cut for _, n, cut, _, _ in want)
            assert docs.count() == before.count()
        else:
            assert docs.subtract(before).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0


def test_run_on_the_small_tables(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert ids < every and len(ids) > 0.7 * len(every)

"""The pipeline over a small table, each stage against what it must leave."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusloom.llm import bpe, simhash, suffix_dedup, toxicity  # noqa: E402
from corpusloom.llm.common import stash  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)
    kept = stash(stages["toxicity"](spark, docs, sf))
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(toxicity.remainder(3) != 1)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels, "toxic", toxicity._fit_bytes)).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s < toxicity.DECISION}
    single = stash(stages["simhash near-dedup"](spark, kept, sf))
    assert single.columns == columns
    found = simhash.near_duplicates(kept).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in found})
    rest = stash(stages["suffix-array dedup"](spark, single, sf))
    assert rest.columns == columns
    before = {r.doc_id: r.text for r in single.collect()}
    want = dict(zip(before, suffix_dedup.brute_force(list(before.values()))))
    assert all(len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] for r in rest.collect())
    mixed = stash(stages["mixing"](spark, rest, sf))
    assert mixed.columns == columns and mixed.count() > 0
    ids = stages["bpe"](spark, mixed, sf).collect()
    model = bpe.WordBpe(bpe.tokenizer_path())
    texts = [r.text for r in mixed.collect()]
    assert sorted(bytes(r.ids) for r in ids) == sorted(model.encode(texts))
    assert all(len(np.frombuffer(bytes(r.ids), "<u4")) == r.n_tokens for r in ids)

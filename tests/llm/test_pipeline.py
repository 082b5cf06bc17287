import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus_pipeline  # noqa: E402
from helpers import messy_docs  # noqa: E402
from test_dedup_operators import brute_links  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality_filter(spark, docs, SF)
    kept = {r.doc_id: r.text for r in good.collect()}
    known = [i for i in labels]
    assert np.mean([(i in kept) == (labels[i] == 1) for i in known]) >= 0.95
    once = corpus_pipeline.exact_dedup(spark, good, SF)
    want = {}
    for i, t in kept.items():
        want[t] = max(i, want.get(t, i))
    left = {r.doc_id: r.text for r in once.collect()}
    assert set(left) == set(want.values())
    apart = corpus_pipeline.near_dedup(spark, once, SF)
    classes = brute_links(left)
    assert {r.doc_id for r in apart.collect()} == {c[0] for c in classes.values()}
    assert good.columns == once.columns == apart.columns == docs.columns
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} == {c[0] for c in classes.values()}


def test_stages_on_awkward_rows(spark):
    docs = messy_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0
    assert corpus_pipeline.packing(spark, docs, SF).count() >= docs.count()
    assert corpus_pipeline.packing(spark, docs.where("1 = 0"), SF).count() == 0

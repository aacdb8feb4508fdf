"""The stages of the pipeline, each on its predecessor's rows."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from loomery.llm.common import store
from loomery.llm.toxicity import toxicity
from tests.llm.test_documents import _check_pieces, _linked, _shingle_sets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    bad = {r.doc_id for r in toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).where("predicted = 1").collect()}
    all_ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in kept["toxicity"]} == all_ids - bad

    first = {}
    for r in sorted(kept["toxicity"], key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in kept["exact_dedup"]} == set(first.values())

    rows = [(r.doc_id, r.text or "", r.source) for r in kept["exact_dedup"]]
    want = _linked(_shingle_sets(rows, 5), 80)
    assert {r.doc_id for r in kept["near_dedup"]} == set(want.values())

    times = Counter(r.doc_id for r in kept["mixing"])
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in kept["near_dedup"]}

    texts = defaultdict(list)
    for r in kept["mixing"]:
        texts[r.doc_id].append(r.text or "")
    _check_pieces(kept["packing"], texts, 4096)


def test_odd_rows_pass_every_stage(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names; and a table without rows."""
    labels = spark.createDataFrame([(1, 0), (8, 0), (10, 1)], "doc_id long, toxic int")
    for name, docs in (("odd", odd), ("none", odd.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at, docs = f"{tmp_path}/{name}", spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            was, docs = docs, store(f(spark, docs, at), f"odd-{stage}")
            assert docs.columns == was.columns
            assert docs.count() <= was.count() * 3
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at)
        n = docs.where("text is null or text = ''").count()
        assert pieces.where("doc_tokens = 1").count() >= n and (pieces.count() > 0) == (name == "odd")

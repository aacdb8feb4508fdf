"""Toxicity: scores by hand, length, labels that teach nothing, rows that are odd."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import toxicity

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet")


@pytest.fixture(scope="module")
def model(spark, labels):
    return toxicity.train(spark.read.parquet(f"{D}/documents.parquet"), labels)


@pytest.fixture(scope="module")
def held(spark, labels, model):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    held = docs.join(labels.where(toxicity.held_out(F.col("doc_id"))), "doc_id").select("doc_id", "text", "toxic")
    return toxicity.score(held, model, ["text", "toxic"]).collect()


def _by_hand(text, model):
    """The score of one text, word by word."""
    weights, bias = model
    words = [w for w in (text or "").lower().split() if w.strip(toxicity.EDGE)]
    if not words:
        return 0.0
    parts = [float(np.mean(weights[toxicity.buckets([w])[0]].astype(float))) for w in words]
    shares = [math.exp(p - max(parts)) for p in parts]
    mean = sum(p * s for p, s in zip(parts, shares)) / sum(shares)
    return 1 / (1 + math.exp(-(mean + bias)))


def test_scores_by_hand(held, model):
    for r in held[:150]:
        assert r["__score"] == pytest.approx(_by_hand(r.c0, model), abs=1e-9)


def test_length_alone_is_not_toxic(spark, held, model):
    """Clean held-out texts, repeated to millions of characters, stay clean; toxic texts among some thousand words show."""
    clean = [r.c0 for r in held if r.c1 == 0 and r["__score"] < 0.5]
    bad = sorted((r.c0 for r in held if r.c1 == 1 and r["__score"] >= 0.5), key=len)
    assert len(clean) > 500 and len(bad) > 50
    rows = [("clean", " ".join(clean * 5)), ("clean", " ".join(clean[:1] * 3000))]
    rows += [("clean", " ".join(clean[i : i + n])) for n in (5, 20, 100) for i in range(0, 100, 20)]
    rows += [("toxic", " ".join([*clean[i : i + 5], b, *clean[i + 5 : i + 10]])) for i, b in enumerate(bad)]
    rows += [("same", b) for b in bad[:5]] + [("same", " ".join([b] * 200)) for b in bad[:5]]
    got = [(r.c0, r["__score"]) for r in toxicity.score(spark.createDataFrame(rows, "kind string, text string"), model, ["kind"]).collect()]
    assert all(s < 0.5 for k, s in got if k == "clean")
    assert np.mean([s >= 0.5 for k, s in got if k == "toxic"]) >= 0.85
    same = sorted(s for k, s in got if k == "same")
    assert len({round(s, 9) for s in same}) <= 5


def test_long_labelled_texts_are_learnt_from():
    size = toxicity.SAMPLE_BYTES
    assert toxicity.within([(1, 0, 20 * size), (2, 1, 5 * size), (3, 0, 9), (4, 1, 1000 * size)]) == [2, 1, 3]


@pytest.mark.parametrize("left", ["false", "toxic = 0", "toxic = 1"])
def test_without_labels_of_both_kinds_nothing_is_toxic(spark, odd, left):
    labels = spark.createDataFrame([(1, 0), (9, 1), (10, 1), (12, 0)], "doc_id long, toxic int").where(left)
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, labels).collect()} == {(0.0, 0)}
    assert toxicity.drop_toxic(odd, labels).count() == odd.count()


def test_dropping_toxic_rows(spark, odd, empty, labels, model, monkeypatch):
    """Columns stay, also with clashing names; null and empty texts stay; an empty table stays empty."""
    monkeypatch.setattr(toxicity, "train", lambda *a: model)
    bad = spark.createDataFrame([(50, "you stupid worthless moron, pathetic idiot trash")], "doc_id long, text string")
    more = odd.unionByName(bad, allowMissingColumns=True)
    left = toxicity.drop_toxic(more, labels)
    assert left.schema == more.schema
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(r.doc_id or 0 for r in odd.collect())
    assert {r.doc_id: r.text for r in left.collect()}[3] is None
    assert toxicity.drop_toxic(empty, labels).columns == odd.columns and toxicity.drop_toxic(empty, labels).count() == 0

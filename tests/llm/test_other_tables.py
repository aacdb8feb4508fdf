"""Archives of pages and nearest neighbours of embeddings."""

import base64
import hashlib
import random

import numpy as np
import pytest

from loomery.llm import archive, nearest, queries


def test_op9(spark, sf_dir):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    top = {}
    for i in sorted(pages):
        top[pages[i]] = i
    rows = archive.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).orderBy("position").collect()
    assert queries.op9_warc(spark, sf_dir).count() == len(rows)
    assert [r.position for r in rows] == list(range(len(pages)))
    order = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert order == sorted(order)
    for r in rows:
        html = pages[r.page_id]
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        own = top[html] == r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(html.encode()), digest, "response" if own else "revisit")
        assert r.refers_to == (None if own else top[html])


def test_odd_pages(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n\x00é"
    rows = [
        (1, "http://www.x.org/a", None, "q"),
        (2, None, "", "q"),
        (3, "http://x.org:80/a\r\nEvil: 1 %41", tricky, None),
        (4, "https://[bad", tricky, None),
        (None, "http://x.org/n", "null id", None),
        (None, "http://x.org/n", tricky, None),
        (5, "http://x.org/z", "same", None),
        (5, "http://x.org/z", "same", None),
        (6, "http://x.org/big", "é" * 300_000, None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    out = archive.archive_pages(df, str(tmp_path / "w"))
    got = sorted(out.collect(), key=lambda r: (r.page_id or 0, r.payload_bytes))
    assert len(got) == len(rows)
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in got]
    assert kinds == [
        (None, "response", None), (None, "revisit", 4), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4),
        (4, "response", None), (5, "response", None), (5, "response", None), (6, "response", None),
    ]
    assert got[4].payload_bytes == len(tricky.encode()) and got[-1].payload_bytes == 600_000
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    back = {r[3]: r for r in archive.parse_archive(data)}
    assert back[3][4] == "http://x.org:80/a\r\nEvil: 1 %41"
    assert archive.archive_pages(df.where("false")).count() == 0


def test_losers_merge_runs():
    rng = random.Random(8)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = []
        for r in range(k):
            rows = [(f"r{r}", n, 0, "", rng.randrange(5), rng.choice(["a", "b", None]), str(rng.randrange(3))) for n in range(rng.randrange(6))]
            runs.append(sorted(rows, key=archive._order))
        merged = list(archive.merge_runs(runs))
        assert sorted(merged, key=str) == sorted((x for r in runs for x in r), key=str)
        keys = [archive._order(x) for x in merged]
        assert keys == sorted(keys)


def test_url_keys():
    assert archive.url_key("HTTP://WWW.Example.org:80/A/?q=1") == "org,example)/a?q=1"
    assert archive.url_key("https://a.b:8443") == "b,a:8443)/"


def _recall(rows, vectors, ids, k):
    hit = total = 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        at = np.flatnonzero(ids == q)[0]
        d = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:k]
        hit += len({r.vec_id for r in found} & set(ids[best].tolist()))
        total += k
        assert [r["rank"] for r in found] == list(range(1, k + 1))
        assert [r.score for r in found] == pytest.approx([d[np.flatnonzero(ids == r.vec_id)[0]] for r in found])
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
    return hit / total


def test_op5(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert _recall(queries.op5_nearest(spark, d).collect(), vectors, ids, 10) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.5]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(df, query_every=100, k=10).collect())
    assert got == [(0, 1, 7, 0.0), (0, 2, 8, 0.0), (0, 3, 1, 1.0)]
    assert nearest.nearest(df.where("false")).count() == 0


def test_equal_vectors_are_ties_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(3000)], "vec_id long, embedding array<float>")
    got = nearest.nearest(df, query_every=1000, k=3).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, k): v for q, vs in ((0, (1, 2, 3)), (1000, (0, 1, 2)), (2000, (0, 1, 2))) for k, v in zip((1, 2, 3), vs)}


def test_blocks_of_rows_and_queries_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(nearest, "ROWS_PER_LIST", 50)
    vectors = np.random.default_rng(1).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = nearest.nearest(df, query_every=10, k=5, probes=10**6).collect()
    assert len(rows) == 200 and _recall(rows, vectors, np.arange(400), 5) == 1

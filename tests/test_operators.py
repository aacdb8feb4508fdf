"""Operators on small inputs, against plain Python."""

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import fnv, fold_key, identifier_words, line_count, shape_bits, shingles, words
from loomery.operators import graph
from loomery.operators.intervals import owner_join, span_union
from loomery.operators.stats import clopper_pearson
from loomery.plans.clones import hash_pairs, winnow
from loomery.plans.scoring import ratchet
from loomery.plans.texts import shared_pairs


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def _reach(pairs, start):
    seen, todo = {start: 0}, [start]
    for x in todo:
        for a, b in pairs:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    return sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(35)})


def test_depths(spark, pairs):
    got = {r.id: r.depth for r in graph.depths(_edges(spark, pairs), spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == _reach(pairs, 0)


def test_closure_and_strong_components(spark, pairs):
    far = {(a, b) for a, c in pairs for b in _reach(pairs, c)}
    assert {tuple(r) for r in graph.closure(_edges(spark, pairs)).collect()} == far
    mutual = {a: {b for b in range(30) if (a, b) in far and (b, a) in far and a != b} for a in range(30)}
    want = {(a, min(m | {a}), len(m) + 1) for a, m in mutual.items() if m}
    assert {tuple(r) for r in graph.strong_components(_edges(spark, pairs)).collect()} == want


def test_components(spark, pairs):
    both = pairs + [(b, a) for a, b in pairs]
    want = {(a, min(_reach(both, a))) for p in pairs for a in p}
    assert {tuple(r) for r in graph.components(_edges(spark, pairs)).collect()} == want


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    """Two paths of two thousand nodes, numbered out of order: labels double their reach each round."""
    monkeypatch.setattr(graph, "MAX_ROUNDS", 40)
    order = [(i * 7919) % 2003 for i in range(2000)]
    path = list(zip(order, order[1:]))
    got = {tuple(r) for r in graph.components(_edges(spark, path + [(a + 5000, b + 5000) for a, b in path])).collect()}
    low = min(order)
    assert got == {(i, low) for i in order} | {(i + 5000, low + 5000) for i in order}


def test_levels(spark):
    got = {tuple(r) for r in graph.levels(_edges(spark, [(1, 2), (2, 3), (1, 3), (4, 3)])).collect()}
    assert got == {(1, 2), (2, 1), (3, 0), (4, 1)}


def test_graph_of_no_edges(spark):
    none = _edges(spark, [])
    assert graph.closure(none).count() == 0
    assert graph.components(none).count() == 0
    assert graph.strong_components(none).count() == 0


def test_owner_is_the_shortest_span(spark):
    spans = spark.createDataFrame([("f", 0, 100, 1), ("f", 10, 20, 2), ("f", 10, 20, 3), ("g", 0, 5, 4)], "k string, first long, last long, id long")
    points = spark.createDataFrame([("f", 15), ("f", 90), ("f", 101), ("g", 5), ("h", 1)], "k string, at long")
    assert {tuple(r) for r in owner_join(points, spans, "k", 8).collect()} == {("f", 15, 2), ("f", 90, 1), ("f", 101, None), ("g", 5, 4), ("h", 1, None)}


def test_touching_spans_are_one(spark):
    spans = spark.createDataFrame([("f", 0, 5), ("f", 5, 7), ("f", 9, 10), ("f", 1, 2), ("f", 1, 2)], "k string, first long, last long")
    assert {tuple(r) for r in span_union(spans, "k").collect()} == {("f", 0, 7), ("f", 9, 10)}


def test_text_functions(spark):
    df = spark.createDataFrame([("parseHTTPReply2_x", "a\nb\n"), ("", ""), (None, None)], "name string, text string")
    df = df.withColumn("w", words(F.col("text")))
    got = df.select(identifier_words("name").alias("i"), line_count(F.col("text")).alias("n"), shingles(F.col("w"), 2).alias("s")).collect()
    assert (got[0].i, got[0].n, got[0].s) == (["parse", "http", "reply", "2", "x"], 2, ["a b"])
    assert got[1].n == 0 and got[2].n == 0 and got[2].s == []
    bits = spark.createDataFrame([("a_b",), ("A-1",), ("9é",)], "s string").select(shape_bits(F.col("s")).alias("b"), fold_key(F.col("s")).alias("f")).collect()
    assert [r.b for r in bits] == [5, 42, 80]
    assert [r.f for r in bits] == ["ab", "a1", "9é"]


def test_winnowing_finds_shared_runs(spark):
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(8)]
    rows = [(d, k, h) for d in (1, 2) for k, h in enumerate([f"{d}{rng.random()}" for _ in range(9)] + shared)]
    prints = winnow(spark.createDataFrame(rows, "id long, k int, h string"), 4)
    assert hash_pairs(prints).where("id_a <> id_b").count() > 0


def test_hot_groups_are_chained(spark):
    prints = spark.createDataFrame([(i, 0, "x") for i in range(10)], "id long, k int, h string")
    assert hash_pairs(prints, hot=10).count() == 45
    chain = {(r.id_a, r.id_b) for r in hash_pairs(prints, hot=9).collect()}
    assert chain == {(i, i + 1) for i in range(9)}


def test_shared_pairs_keeps_every_pair_of_that_similarity(spark):
    rng = random.Random(5)
    sets = {}
    for i in range(40):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.7 else frozenset(rng.sample(range(60), 12))
        sets[i] = frozenset(set(base) ^ set(rng.sample(range(60), rng.randrange(3))))
    df = spark.createDataFrame([(i, str(x)) for i, s in sets.items() for x in s], "id long, s string")
    got = {(r.id_a, r.id_b): r.n_both for r in shared_pairs(df, 0.8).collect()}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert got[a, b] == len(sets[a] & sets[b])


def test_ratchet(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 5, None), (3, 100, 110), (4, 1000, 1021), (5, 1000, 1020)], "id long, base long, now long")
    assert {(r.id, r.verdict) for r in ratchet(df).collect()} == {(1, "added"), (2, "removed"), (3, "held"), (4, "over"), (5, "held")}


def test_exact_intervals(spark):
    rows = spark.createDataFrame([(10, 0), (10, 10), (20, 5)], "n long, x long")
    got = {(r.n, r.x): (r.low, r.high) for r in clopper_pearson(rows).collect()}
    assert got[10, 0] == (0.0, pytest.approx(308.5, abs=0.1))
    assert got[10, 10] == (pytest.approx(691.5, abs=0.1), 1000.0)
    assert got[20, 5] == (pytest.approx(86.6, abs=0.1), pytest.approx(491.0, abs=0.1))


def test_levels_take_few_rounds_on_long_paths(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(i + 1, i) for i in range(60)] + [(rng.randint(31, 60), rng.randint(0, 30)) for _ in range(60)] + [(90, 60), (91, 0)]
    want = {}
    for v in [*range(61), 90, 91]:
        want[v] = max((want[b] + 1 for a, b in edges if a == v), default=0)
    df = _edges(spark, edges)
    monkeypatch.setattr(graph, "MAX_ROUNDS", 12)
    assert {tuple(r) for r in graph.levels(df).collect()} == set(want.items())
    # Several blocks, in an order that leaves some nodes out.
    order = spark.createDataFrame([(v, float(v)) for v in range(61)], "id long, key double")
    assert {tuple(r) for r in graph.levels(df, order, 50).collect()} == set(want.items())
    with pytest.raises(RuntimeError, match="cycle"):
        graph.levels(_edges(spark, [(1, 2), (2, 1)]), None, 1)


def test_pairs_of_texts_are_merged_not_broadcast(spark):
    sets = spark.createDataFrame([(i, f"{i // 3}-{k}") for i in range(12) for k in range(9)], "id long, s string")
    for df in (shared_pairs(sets, 0.8), hash_pairs(sets.selectExpr("id", "s AS h", "0 AS k"))):
        assert df.count() > 0
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_intervals_of_many_trials(spark):
    """Summed term by term for few trials; many take no longer."""
    rates = [(n, x) for n in (1, 7, 60) for x in range(0, n + 1, 3)] + [(200_000_000, 40_000_000)]
    got = {(r.n, r.x): (r.low / 1000, r.high / 1000) for r in clopper_pearson(spark.createDataFrame(rates, "n long, x long")).collect()}
    for n, x in rates[:-1]:
        low, high = got[n, x]
        at_least = lambda k, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert low == 0 if x == 0 else at_least(x, low - 1e-6) < 0.025 < at_least(x, low + 1e-6)
        assert high == 1 if x == n else at_least(x + 1, high - 1e-6) < 0.975 < at_least(x + 1, high + 1e-6)
    wide = 1.96 * (0.2 * 0.8 / 200_000_000) ** 0.5
    assert got[rates[-1]] == pytest.approx((0.2 - wide, 0.2 + wide), abs=2e-6)


def test_signature_of_a_large_set_equals_plain():
    rng = random.Random(2)
    for size in (1, 5, 1024, 1500):
        x = [rng.getrandbits(63) * rng.choice((1, -1)) for _ in range(size)]
        want = []
        for i in (0, 1, 77, 127):
            hashes = []
            for e in x:
                h = fnv.BASIS
                for byte in (e % 2**64).to_bytes(8, "little") + i.to_bytes(4, "little"):
                    h = (h ^ byte) * fnv.PRIME % 2**64
                hashes.append(h)
            want.append(min(hashes))
        assert [int(v) for v in fnv.signature(np.array(x, np.int64))[[0, 1, 77, 127]]] == want

"""Steps whose tasks are counted by what they hold, and labels that go along an edge together."""

import random
import re
from collections import Counter

from loomery.operators import graph
from loomery.plans import architecture, clones, history, structure
from loomery.sources import facts


def test_tasks_of_pairs_grow_with_the_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(history, "LINES", 400)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 400 + 1
    for name in ("cochange", "three_signal_join"):
        plan = getattr(history, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert name != "cochange" or ("hashpartitioning(a#" in plan and f", {n})" in plan)
    # Twins are in no exchange: neither side of their join is a full outer one any more.
    assert "FullOuter" not in plan


def test_a_node_has_a_row_for_many_labels(spark, monkeypatch):
    rng, rows, settle = random.Random(3), [], graph.settled

    def noted(df, what="step"):
        out = settle(df, what)
        if what == "reached":
            rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "settled", noted)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)]
    start = [(f"l{i}", rng.randrange(60)) for i in range(150)] + [("far", 99)]
    want = set()
    for label, at in start:
        seen, todo = {at}, [at]
        while todo:
            x = todo.pop()
            more = {b for a, b in edges if a == x} - seen
            seen |= more
            todo += more
        want |= {(label, x) for x in seen}
    got = graph.labelled_reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(start, "label string, id long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(rows) <= 61 * 3 < len(want)


def test_tasks_of_clones_grow_with_the_turns(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(9))
    spark.createDataFrame([(i, 0, text) for i in range(90)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plans, settle = [], clones.settled

    def noted(df, what="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, what)

    monkeypatch.setattr(clones, "settled", noted)
    monkeypatch.setattr(clones, "TURNS", 8)
    assert clones.clone_groups(spark, str(tmp_path)).count() == 90
    # Texts are dealt by turn, their parts by hash.
    assert f", {90 // 8 + 1})" in plans[0] and "hashpartitioning(h#" in plans[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_references_grow_with_the_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(facts, "LINES", 400)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 400 + 1
    for plan, keys in ((_plan(facts.refs(spark, sf_dir)), ("l_orderkey", "src")), (_plan(structure.ref_participation(spark, sf_dir)), ("l_orderkey", "src", "dst"))):
        for key in keys:
            assert re.search(rf"hashpartitioning\({key}#[^)]*, {n}\)", plan), key
        assert "Broadcast" not in plan


def test_misplaced_files_are_counted_in_tasks_that_grow(spark, tmp_path, monkeypatch):
    """Three groups of two directories; file 0 refers to the two groups that are not its own equally often."""
    rng = random.Random(6)
    parts = [(i, "a b", "t", f"B#{i % 6}", 9) for i in range(36)]
    orders = [[rng.choice(range(group or 3, 36, 3)) for _ in range(5)] for group in (0, 1, 2) for _ in range(70)]
    orders += [[0, x] for group in (1, 2) for x in range(group, 36, 3)] + [[rng.randrange(1, 36) for _ in range(3)] for _ in range(20)]
    lines = [(o, k, x) for o, files in enumerate(orders) for k, x in enumerate(files, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(facts, "LINES", 60)
    n, made = len(lines) // 60 + 1, []
    settle = architecture.settled
    monkeypatch.setattr(architecture, "settled", lambda df, what="step": (made.append(what), settle(df, what))[1])
    df = architecture.misplaced_files(spark, str(tmp_path))
    # References are placed once for both uses, and ends are dealt by file.
    assert made.count("placed") == 1
    assert re.search(rf"hashpartitioning\(id#\d+L, {n}\)", _plan(df))
    cluster = {r.dir: r.cluster for r in architecture.dir_clusters(spark, str(tmp_path)).collect()}
    assert len(set(cluster.values())) == 3
    dir_of = lambda x: f"b{x % 6}/t/a"
    refs = {(a, b, k) for files in orders for k, (a, b) in enumerate(zip(files, files[1:])) if a != b}
    near = Counter((x, cluster[dir_of(y)]) for a, b, _ in refs for x, y in ((a, b), (b, a)))
    want = set()
    for x in {x for x, _ in near}:
        own = cluster[dir_of(x)]
        most, best = max(((c, name) for (y, name), c in near.items() if y == x and name != own), default=(0, None))
        if most > near[x, own]:
            want.add((x, dir_of(x), own, best, near[x, own], most))
    assert df.columns == ["id", "dir", "cluster", "belongs", "n_own", "n_best"]
    assert {tuple(r) for r in df.collect()} == want
    tied = max(cluster[dir_of(1)], cluster[dir_of(2)])
    assert (0, dir_of(0), cluster[dir_of(0)], tied, 0, 12) in want

"""Cases that the tables of the other tests are too small to show."""

import duckdb
import pytest

from loomery.operators import graph
from loomery.plans import registry
from loomery.plans.clones import covered, followed, runs
from loomery.plans.structure import redundancy_rollup


def test_large_clone_blocks_count(spark, tmp_path):
    """Thirty equal parts are one block of each directory they lie in, as a pair is."""
    parts = [(i, "a b", "t", f"B#{i % 3}", 9) for i in range(30)] + [(30, "a c", "t", "B#0", 9), (31, "a c", "t", "B#0", 9), (32, "a d", "t", "B#0", 9)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    none = spark.createDataFrame([], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string")
    none.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.dir: r.clone_blocks for r in redundancy_rollup(spark, str(tmp_path)).collect()}
    assert got == {"b0/t/a": 2, "b1/t/a": 1, "b2/t/a": 1}


def _grams(spark, streams):
    return spark.createDataFrame([(i, k, " ".join(w[k : k + 5])) for i, w in streams.items() for k in range(len(w) - 4)], "id long, k int, h string")


def test_frequent_copies_are_runs(spark):
    """A text in 70 streams is found in each of them, and it continues the longer copy of two."""
    common = [f"c{i}" for i in range(8)]
    streams = {i: [f"x{i}", *common, f"y{i}"] for i in range(70)}
    streams[3] = [*[f"p{i}" for i in range(7)], *common, *[f"q{i}" for i in range(7)]]
    streams[60] = ["z", *streams[3], "z"]
    got = runs(_grams(spark, streams)).collect()
    assert (3, 60, 0, 1, 22) in {tuple(r) for r in got}
    assert {(r.id_a, r.id_b) for r in got} >= {(i, i + 1) for i in range(69)}
    assert {r.n for r in got} == {8, 22}
    edges = spark.createDataFrame([(r.id_a, r.id_b) for r in got], "src long, dst long")
    assert {r.component for r in graph.components(edges).collect()} == {0}
    want = {(i, 1, 9) for i in range(70)} - {(3, 1, 9), (60, 1, 9)} | {(3, 0, 22), (60, 1, 23)}
    assert {tuple(r) for r in covered(_grams(spark, streams)).collect()} == want


def test_hot_groups_are_chained_across_ranges(spark):
    """The next row of a group is found within a range of ids and across empty ranges."""
    rows = [(i, k, "hot") for i in (1, 2, 9, 10, 57, 58) for k in (0, 5)] + [(3, 1, "other")]
    got = followed(spark.createDataFrame(rows, "id long, k int, h string"), width=8).collect()
    hot = sorted((r.id, r.k) for r in got if r.h == "hot")
    assert {((r.id, r.k), r.next and tuple(r.next)) for r in got if r.h == "hot"} == set(zip(hot, hot[1:] + [None]))
    assert [r.next for r in got if r.h == "other"] == [None]


def test_labelled_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 5)], "src long, dst long")
    start = spark.createDataFrame([("a", 1), ("b", 5), ("b", 4), ("c", 9), ("a", 1)], "label string, id long")
    got = sorted(tuple(r) for r in graph.labelled_reach(edges, start).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 9)]


@pytest.mark.parametrize("name", ["clone_runs", "clone_groups", "cloned_spans", "fingerprint_pairs"])
def test_frequent_copies_equal_sql(spark, tmp_path, name):
    """Plan and SQL agree where a text is in more turns than a group may pair up in full."""
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(i // 4, i % 4, f"x{i} {common} y{i}" + (f" tail of some {common}" if i % 9 == 0 else "")) for i in range(80)]
    rows += [(90, 0, f"p q r s t u v {common} a b c d e f g"), (91, 0, f"z p q r s t u v {common} a b c d e f g z"), (92, 0, None), (93, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    wanted = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted.fetchall())


def test_spans_of_a_frequent_part_that_a_turn_repeats_equal_sql(spark, tmp_path):
    common = " ".join(f"c{i}" for i in range(9))
    rows = [(i, 0, f"x{i} {common} y{i}") for i in range(70)] + [(30, 1, f"a {common} b {common} d {common} e"), (31, 1, f"{common} g {common} h {common} i {common}")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    wanted = con.execute(registry.ORACLE_SQL["cloned_spans"])
    columns = [d[0] for d in wanted.description]
    got = registry.QUERIES["cloned_spans"](spark, str(tmp_path)).select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted.fetchall())

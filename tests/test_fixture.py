"""Queries that the given tables leave without rows, on a few conversations, against their SQL."""

import duckdb
import pytest

from loomery.plans import registry


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("talks"))
    long = " ".join(f"w{i}" for i in range(60))
    near = " ".join(f"w{i}" if i != 59 else "other" for i in range(60))
    run = "start here " + " ".join(f"w{i}" for i in range(52)) + " " + " ".join(f"x{i}" for i in range(40))
    short = " ".join(f"w{i}" for i in range(20)) + " " + " ".join(f"y{i}" for i in range(30))
    rows = [(0, 0, "user", "one\ntwo"), (0, 2, "user", "one\none\ntwo\nthree"), (1, 0, "user", long), (1, 1, "user", near), (2, 0, "user", run), (2, 1, "user", short)]
    rows += [(3, 0, "user", None), (3, 1, "user", "")]
    # A run that more turns have than are paired: it is chained.
    rows += [(4 + i // 9, i % 9, "user", " ".join(f"z{j}" for j in range(55)) + f" end{i}") for i in range(70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{home}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{home}/conversations.parquet/*.parquet')")
    return home, con


@pytest.mark.parametrize("name", ["turn_duplicates", "duplicated_spans", "erased_names", "run_floor", "sentence_counts", "kind_shingles"])
def test_few_conversations(spark, talks, name):
    home, con = talks
    df = registry.QUERIES[name](spark, home)
    got = con.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in df.columns]
    found = sorted(map(str, (tuple(r) for r in df.collect())))
    assert found == sorted(str(tuple(r[i] for i in at)) for r in got.fetchall()) and found


def test_either_arm_makes_duplicates(spark, talks):
    out = {(r["id_a"], r["id_b"]): (r["near"], r["run"]) for r in registry.QUERIES["turn_duplicates"](spark, talks[0]).collect()}
    one = 1 << 20
    assert out[one, one + 1] == (True, True) and out[one, 2 * one] == (False, True) and not any(2 * one + 1 in p for p in out)

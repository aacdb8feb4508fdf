"""Coverage of runs by longer ones, and series in batches."""

import random

import pytest

from loomery.operators.coverage import coverage
from loomery.streaming.series import WINDOW, Series


def _plain(runs, least, own):
    """Token by token."""
    out, seen = {}, {}
    for a, b, x, y, n in sorted(runs, key=lambda r: (r[0], r[1], -r[4], r[2], r[3])):
        left, right = seen.setdefault((a, b), (set(), set()))
        new = min(len(set(range(x, x + n)) - left), len(set(range(y, y + n)) - right))
        out[a, b, x, y, n] = "dropped" if n < least else "suppressed" if new < own else "reported"
        if out[a, b, x, y, n] == "reported":
            left.update(range(x, x + n))
            right.update(range(y, y + n))
    return out


def test_coverage(spark):
    rng = random.Random(5)
    runs = {(rng.randint(0, 3), 9, rng.randint(0, 80), rng.randint(0, 80), rng.randint(1, 30)) for _ in range(400)}
    df = spark.createDataFrame(sorted(runs), "id_a long, id_b long, start_a long, start_b long, n long")
    got = {(r.id_a, r.id_b, r.start_a, r.start_b, r.n): r.verdict for r in coverage(df, 8, 6).collect()}
    assert got == _plain(runs, 8, 6) and set(got.values()) == {"dropped", "suppressed", "reported"}
    assert coverage(df.where("false"), 8, 6).count() == 0


def test_batches_in_any_split_equal_one(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "step long, value double")
    for n in (1, 4):
        series = Series(spark, str(tmp_path / f"s{n}"))
        assert series.rows("m").count() == 0 and series.pending(df, "m") == 60
        series.append("old", df.where("step < 30").withColumn("value", df.value * 0), "older")
        cuts = [0, *sorted(rng.sample(range(1, 60), n - 1)), 60]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            # Batches overlap, and each is run twice, as after a failure.
            for _ in range(2):
                series.append(f"b{k}", df.where(f"step >= {max(0, a - 9)} and step < {b}"), "m")
            assert series.pending(df, "m") == 60 - b
        assert sorted((r.step, r.value) for r in series.rows("m").collect()) == rows
        assert {r.value for r in series.rows("older").collect()} == {0.0}
    assert sorted(r.step for r in series.window("m", 5).collect()) == [55, 56, 57, 58, 59]
    with pytest.raises(ValueError):
        series.window("m", WINDOW + 1)


def test_a_batch_that_comes_first_again_takes_nothing_from_others(spark, tmp_path):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "step long, value double")
    series = Series(spark, str(tmp_path / "s"))
    series.append("a", df.where("step < 6"), "m")
    series.append("b", df, "m")
    series.append("a", df.where("step < 6"), "m")
    assert sorted(r.step for r in series.rows("m").collect()) == list(range(10))


def test_coverage_goes_through_pairs_in_one_pass(spark):
    # A pair's runs lie in several batches, and no group is gathered per pair.
    rows = [(p, p + 1, s * 5, s * 5 + d, n) for p in range(30) for s in range(9) for d in (0, 3) for n in (6, 9, 9 + s)]
    df = spark.createDataFrame(rows, "id_a long, id_b long, start_a long, start_b long, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = coverage(df, 8, 6)
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for p in range(30):
        seen = (set(), set())
        for a, b, s, t, n in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[4], r[2], r[3])):
            ends = (set(range(s, s + n)), set(range(t, t + n)))
            verdict = "dropped" if n < 8 else "suppressed" if min(len(e - x) for e, x in zip(ends, seen)) < 6 else "reported"
            if verdict == "reported":
                for e, x in zip(ends, seen):
                    x |= e
            want.append((a, b, s, t, n, verdict))
    assert got == sorted(want)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()

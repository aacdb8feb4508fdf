"""Relocated units against a plain version."""

import random

from loomery.plans import changes
from loomery.plans.changes import relocated


def _plain(rows):
    out = set()
    for key in {r[:2] for r in rows}:
        sides = {s: {(u, b) for f, p, s2, u, b in rows if (f, p) == key and s2 == s} for s in ("before", "after")}
        gone, come = sides["before"] - sides["after"], sides["after"] - sides["before"]
        moved = {b for _, b in gone} & {b for _, b in come}
        for unit in {u for u, _ in sides["before"]} & {u for u, _ in sides["after"]}:
            x, y = [b for u, b in gone if u == unit], [b for u, b in come if u == unit]
            if x + y and moved.issuperset(x + y):
                out.add((*key, unit, len(x), len(y)))
    return out


def test_relocated_units(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.randrange(3), rng.choice(["before", "after"]), rng.choice("uvwxy"), rng.randrange(9)) for _ in range(700)]
    rows += [(9, 0, "before", "u", 1), (9, 0, "after", "v", 1), (9, 0, "before", "v", 2), (9, 0, "after", "v", 2), (9, 0, "before", "u", 2), (9, 0, "after", "u", 2)]
    # Kept as it is, on one side only, and with a line that is new.
    rows += [(9, 1, "before", "u", 1), (9, 1, "after", "u", 1), (9, 1, "before", "w", 5), (9, 1, "before", "x", 1), (9, 1, "after", "x", 7)]
    got = relocated(spark.createDataFrame(rows, "file long, pair long, side string, unit string, body long")).collect()
    want = _plain(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 2
    assert {(9, 0, "u", 1, 0), (9, 0, "v", 0, 1)} <= want and not any(k[:2] == (9, 1) for k in want)


def test_no_lines(spark):
    assert relocated(spark.createDataFrame([], "file long, pair long, side string, unit string, body long")).collect() == []


def test_tasks_grow_with_the_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("loomery.plans.changes.SOLD", 500)
    plan = changes.relocated_units(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert f", {lines // 500 + 1})" in plan

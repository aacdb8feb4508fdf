"""The nearest row before and after, and intervals that lie in no other: ordered problems without pairs.

A key is cut into ranges of its order, so that a key with most of the rows is many tasks; what a
range has to know of the others is carried to it as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beside(asked: DataFrame, units: DataFrame, key: str, before: int, after: int, width: int = 64) -> DataFrame:
    """``asked`` (key, at, id) with ``before_id``, ``after_id``: the nearest of ``units`` (key, at, id).

    Before is at the same place or up to ``before`` earlier, after is later by up to ``after``; of
    units at one place the smallest id counts. Null where there is none, and for null keys or
    places. Limits must not exceed ``width``, the length of a range: then only the neighbouring
    ranges' last and first unit can matter beyond the own range.
    """
    if max(before, after) > width:
        raise ValueError("a limit is wider than a range")
    block = lambda d: d.withColumn("block", F.expr(f"cast(floor(at / {width}) as bigint)"))
    u = block(units.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(key, "at", "id"))
    both = block(asked.select(key, "at", "id")).withColumn("kind", F.lit(1)).unionByName(u.withColumn("kind", F.lit(0)))
    own = F.when(F.col("kind") == 0, F.struct("at", "id"))
    part = Window.partitionBy(key, "block")
    # Units come first at a place; the last of them before a row is that of the smallest id.
    up = part.orderBy("at", "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy("at", "kind", "id").rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("low", F.last(own, ignorenulls=True).over(up)).withColumn("high", F.first(own, ignorenulls=True).over(down)).where("kind = 1")
    ends = u.groupBy(key, "block").agg(F.max_by(F.struct("at", "id"), F.struct("at", -F.col("id"))).alias("last"), F.min(F.struct("at", "id")).alias("first"))
    back = ends.select(F.col(key).alias("k1"), (F.col("block") + 1).alias("b1"), "last")
    ahead = ends.select(F.col(key).alias("k2"), (F.col("block") - 1).alias("b2"), "first")
    near = near.join(back, (F.col(key) == F.col("k1")) & (F.col("block") == F.col("b1")), "left").join(ahead, (F.col(key) == F.col("k2")) & (F.col("block") == F.col("b2")), "left")
    low, high = F.coalesce("low", "last"), F.coalesce("high", "first")
    return near.select(
        key, "at", "id",
        F.when(F.col("at") - low["at"] <= before, low["id"]).alias("before_id"),
        F.when(high["at"] - F.col("at") <= after, high["id"]).alias("after_id"),
    )


def outermost(spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """The rows of ``spans`` (key, first, last, ...) that lie strictly inside no other span of their key.

    Equal spans are not inside each other and stay or go together. A span is inside another if one
    that begins before it, or with it and is longer, reaches its end: a running maximum tells.
    """
    once = spans.select(key, "first", "last").distinct().withColumn("block", F.expr(f"cast(floor(first / {width}) as bigint)"))
    ends = once.groupBy(key, "block").agg(F.max("last").alias("end"))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.max("end").over(earlier)).drop("end")
    reach = F.max("last").over(Window.partitionBy(key, "block").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1))
    told = once.withColumn("reach", reach).join(ends, [key, "block"])
    out = told.where(F.coalesce(F.greatest("reach", "carried") < F.col("last"), F.lit(True)))
    return spans.join(out.select(key, "first", "last"), [key, "first", "last"], "left_semi")

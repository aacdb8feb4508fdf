"""Joins and unions of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def owner_join(points: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """points (key, at, ...) with ``owner``: the shortest span (key, first, last, id) that holds ``at``.

    Spans are dealt into bins of ``width`` so that the join is an equality on (key, bin); a span
    lies in as many bins as it is wide, a point in one. Ties go to the smaller id. Points without
    an owner keep null.
    """
    bins = spans.withColumn("bin", F.explode(F.expr(f"sequence(cast(first div {width} as bigint), cast(last div {width} as bigint))")))
    bins = bins.select(key, "bin", "first", "last", F.col("id").alias("owner"))
    asked = points.withColumn("bin", F.expr(f"cast(at div {width} as bigint)"))
    met = asked.join(bins, [key, "bin"], "left").withColumn("owner", F.when(F.col("at").between(F.col("first"), F.col("last")), F.col("owner")))
    best = F.min(F.when(F.col("owner").isNotNull(), F.struct(F.col("last") - F.col("first"), "owner")))
    return met.groupBy(*points.columns).agg(best["owner"].alias("owner"))


def span_union(spans: DataFrame, key: str) -> DataFrame:
    """key, first, last: spans of a key that touch or overlap as one (ends are exclusive)."""
    by = Window.partitionBy(key).orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.select(key, "first", "last").distinct().withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy(key, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")

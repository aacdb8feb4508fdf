"""Arcs to cut so that a weighted graph has no cycle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import graph
from loomery.session import Rounds, settled

#: Nodes of a strong component up to which the cut is the cheapest there is.
EXACT = 14


def _best_order(arcs: pd.DataFrame) -> list:
    """The order of the nodes whose arcs from a later to an earlier node weigh least, by dynamic programming over subsets."""
    names = sorted(set(arcs["src"]) | set(arcs["dst"]))
    n, place = len(names), {v: i for i, v in enumerate(names)}
    weight = np.zeros((n, n))
    np.add.at(weight, (arcs["src"].map(place), arcs["dst"].map(place)), arcs["w"])
    masks = np.arange(1 << n)
    # back[v][S]: weight of the arcs from v into S, which are cut if S comes first.
    back = np.zeros((n, 1 << n))
    for u in range(n):
        back[:, 1 << u : 2 << u] = back[:, : 1 << u] + weight[:, u : u + 1]
    cost, last = np.full(1 << n, np.inf), np.zeros(1 << n, np.int64)
    cost[0] = 0
    size = np.array([m.bit_count() for m in range(1 << n)])
    for k in range(1, n + 1):
        own = masks[size == k]
        tries = np.full((n, len(own)), np.inf)
        for v in range(n):
            has = (own >> v & 1) == 1
            rest = own[has] ^ (1 << v)
            tries[v, has] = cost[rest] + back[v, rest]
        last[own] = tries.argmin(0)
        cost[own] = tries.min(0)
    order, left = [], (1 << n) - 1
    while left:
        order.append(names[last[left]])
        left ^= 1 << int(last[left])
    return order[::-1]


def _cut_exactly(arcs: pd.DataFrame) -> pd.DataFrame:
    place = {v: i for i, v in enumerate(_best_order(arcs))}
    return arcs.loc[arcs["src"].map(place) > arcs["dst"].map(place), ["src", "dst", "w"]]


def _greedy_order(arcs: DataFrame) -> DataFrame:
    """id, key: an order of the nodes of large components, found in a number of rounds that grows with their logarithm.

    A round sets sinks last and sources first; of the others those go first whose arcs lead out
    more than in, a quarter of each component at a time.
    """
    placed = Rounds(arcs.sparkSession, "placed")
    key = "struct<side: int, round: int, rank: double>"
    schema = arcs.select(F.col("src").alias("id"), F.lit(None).cast(key).alias("key")).schema
    placed.add(arcs.sparkSession.createDataFrame([], schema))
    left = settled(arcs)
    nodes = settled(left.select(F.col("src").alias("id"), "component").union(left.select("dst", "component")).distinct())
    for turn in range(graph.MAX_ROUNDS):
        if nodes.isEmpty():
            return placed.all()
        ends = left.select(F.col("src").alias("id"), F.col("w").alias("o"), F.lit(0).alias("i")).union(left.select("dst", F.lit(0), "w"))
        ends = ends.groupBy("id").agg(F.sum("o").cast("double").alias("o"), F.sum("i").cast("double").alias("i"))
        n = nodes.join(ends, "id", "left").fillna(0.0, ["o", "i"])
        n = settled(n.withColumn("lead", F.when((F.col("o") > 0) & (F.col("i") > 0), (F.col("o") - F.col("i")) / (F.col("o") + F.col("i")))))
        bar = n.groupBy("component").agg(F.percentile_approx("lead", 0.75, 1000).alias("bar"))
        n = n.join(bar, "component")
        side = F.when(F.col("i") == 0, 0).when(F.col("o") == 0, 2).when(F.col("lead") >= F.col("bar"), 1)
        n = settled(n.withColumn("side", side))
        last = F.col("side") == 2
        # What is set last early stays behind what is set last later.
        at = F.struct(last.cast("int").alias("side"), F.when(last, -turn).otherwise(turn).cast("int").alias("round"), F.when(F.col("side") == 1, -F.col("lead")).otherwise(F.lit(-2.0)).alias("rank"))
        placed.add(n.where("side is not null").select("id", at.alias("key")))
        nodes = settled(n.where("side is null").select("id", "component"))
        for end in ("src", "dst"):
            left = left.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        left = settled(left.select("src", "dst", "w", "component"))
    raise RuntimeError("the order did not settle")


def feedback_arcs(edges: DataFrame) -> DataFrame:
    """src, dst, w, exact: the arcs of ``edges`` (src, dst, w) to cut; without them there is no cycle.

    Arcs between components are never cut. In components of up to EXACT nodes the cut weighs least;
    in larger ones the order is greedy and the cut at most half of the component, for of an order
    and its reverse the better one is used. Loops of one node are not arcs and are left out.
    """
    return ordered_cuts(edges)[0]


def ordered_cuts(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``feedback_arcs``, and the order (id, key) that they are cut by in large components, if there are any."""
    edges = settled(edges.where("src <> dst").select("src", "dst", F.col("w").cast("long").alias("w")), "arcs")
    of = graph.strong_components(edges)
    a, b = (of.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"), F.col("size").alias(f"size_{end}")) for end in ("src", "dst"))
    inner = settled(edges.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst", "w", F.col("c_src").alias("component"), F.col("size_src").alias("size")), "arcs")
    kinds = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in ("src", "dst", "w"))
    small = inner.where(F.col("size") <= EXACT).groupBy("component").applyInPandas(_cut_exactly, kinds).withColumn("exact", F.lit(True))
    large = inner.where(F.col("size") > EXACT).select("src", "dst", "w", "component")
    if large.isEmpty():
        return settled(small, "cuts"), None
    order = _greedy_order(large)
    x, y = (order.select(F.col("id").alias(end), F.struct("key", "id").alias(f"at_{end}")) for end in ("src", "dst"))
    ranked = large.join(x, "src").join(y, "dst").select("src", "dst", "w", "component", (F.col("at_src") > F.col("at_dst")).alias("back"))
    ranked = settled(ranked, "ranked-arcs")
    turned = ranked.groupBy("component").agg((F.sum(F.when(F.col("back"), F.col("w")).otherwise(0)) * 2 > F.sum("w")).alias("turned"))
    greedy = ranked.join(turned, "component").where(F.col("back") != F.col("turned")).select("src", "dst", "w", F.lit(False).alias("exact"))
    return settled(small.unionByName(greedy), "cuts"), order

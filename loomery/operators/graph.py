"""Fixpoints over an edge table (src, dst).

Loops are semi-naive where they can be: a round joins only what the last round found, takes away
what is known and ends when nothing is new. Each round is written to the shared folder, so plans
stay small and a lost executor costs one round. The joins shuffle on the node; Spark broadcasts
the side it measures to be small. ``MAX_ROUNDS`` guards against a graph deeper than anyone
expects: passing it is an error, never a shortened answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.session import Rounds, settled

MAX_ROUNDS = 10_000
#: Arcs of a block of nodes whose levels one task finds.
BLOCK = 500_000
#: Labels that one number holds.
BITS = 62


def depths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id, depth: least number of edges from any row of ``start`` (id) to what it reaches, itself 0."""
    step, rounds = settled(edges.select("src", "dst").distinct()), Rounds(edges.sparkSession)
    front = rounds.add(start.select("id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, MAX_ROUNDS):
        found = front.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = rounds.add(found.join(rounds.all(), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return rounds.all()
    raise RuntimeError("the graph is deeper than MAX_ROUNDS")


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id: what ``start`` (id) reaches, itself included."""
    return depths(edges, start).select("id")


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """src, dst: pairs joined by a path of one edge or more, from every node or only from ``start`` (id).

    The result has a row per pair; ask for it where that is what is wanted, and from few nodes.
    """
    step, rounds = settled(edges.select("src", "dst").distinct()), Rounds(edges.sparkSession)
    front = rounds.add(step if start is None else step.join(start.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
    for _ in range(MAX_ROUNDS):
        longer = front.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid")
        front = rounds.add(longer.select("src", "dst").distinct().join(rounds.all(), ["src", "dst"], "left_anti"))
        if front.isEmpty():
            return rounds.all()
    raise RuntimeError("the graph is deeper than MAX_ROUNDS")


def labelled_reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """label, id: what the rows of ``start`` (label, id) of each label reach, themselves included.

    Labels are bits of whole numbers, BITS to each, so a node's labels are few rows and go along an
    edge together; a round hands on the bits that are new.
    """
    step = settled(edges.select("src", "dst").distinct())
    start = settled(start.select("label", "id").distinct(), "starts")
    at = start.select("label").distinct().orderBy("label").withColumn("place", F.monotonically_increasing_id())
    bit = settled(at.select("label", F.expr(f"place div {BITS}").alias("block"), F.expr(f"shiftleft(1L, cast(place % {BITS} as int))").alias("bit")), "labels")
    known = settled(start.join(bit, "label").groupBy("block", "id").agg(F.bit_or("bit").alias("new"), F.lit(0).cast("long").alias("old")), "reached")
    for _ in range(MAX_ROUNDS):
        front = known.where("new <> 0").select("block", F.col("id").alias("src"), "new")
        found = front.join(step, "src").select("block", F.col("dst").alias("id"), "new", F.lit(0).cast("long").alias("old"))
        both = found.unionByName(known.select("block", "id", F.lit(0).cast("long").alias("new"), F.expr("old | new").alias("old")))
        both = both.groupBy("block", "id").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        known = settled(both.withColumn("new", F.expr("new & ~old")), "reached")
        if known.where("new <> 0").isEmpty():
            # A block's labels stand by its rows only here.
            of = bit.groupBy("block").agg(F.collect_list(F.struct("label", "bit")).alias("of"))
            return known.join(of, "block").select("id", "old", F.inline("of")).where("(old & bit) <> 0").select("label", "id")
    raise RuntimeError("the graph is deeper than MAX_ROUNDS")


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id joined with it by edges of either direction; for ends of edges.

    A round takes the smallest label of the neighbours, hands it to the label's own node, and
    follows the label of the label, so long paths shorten by halves. Minima combine before the
    shuffle: the hub of a star is one row per task.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    both = settled(both.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct())
    label = settled(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    for _ in range(MAX_ROUNDS):
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        low = settled(label.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was")))
        # The node that gave its name hears of smaller ones that its namesakes have met.
        heard = low.groupBy(F.col("was").alias("id")).agg(F.min("component").alias("heard"))
        low = settled(low.join(heard, "id", "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("component"), "was"))
        far = low.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = settled(low.join(far, "component", "left").select("id", F.coalesce("far", "component").alias("component"), "was"))
        if new.where("component <> was").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")
    raise RuntimeError("the components did not settle")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have a way in and a way out, peeled until nothing more goes."""
    core = settled(edges)
    left = core.count()
    for _ in range(MAX_ROUNDS):
        inner = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        core = settled(inner.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns))
        before, left = left, core.count()
        if left == before:
            return core
    raise RuntimeError("the graph is deeper than MAX_ROUNDS")


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component, size: nodes that reach each other, named by the smallest, two or more of them.

    Edges that cannot lie on a cycle are peeled off. Then every node learns the smallest node that
    reaches it (its colour) by passing minima along the edges; of one colour, what also reaches the
    node that gave the colour is its strong component. Those leave with their edges, edges between
    colours leave too, and the rest goes round again. A round takes out at least one component per
    colour, and every table has a row per node or edge, never per pair.
    """
    spark = edges.sparkSession
    core = trimmed(edges.where("src <> dst").select("src", "dst").distinct())
    found = Rounds(spark)
    found.add(spark.createDataFrame([], core.select(F.col("src").alias("id"), F.col("dst").alias("component")).schema))
    for _ in range(MAX_ROUNDS):
        if core.isEmpty():
            named = found.all()
            return named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size")
        colour = _colours(core)
        inner = core.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("x")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("y")), "dst")
        inner = settled(inner.where("x = y").select("src", "dst"))
        # Backwards from the namesakes along edges of one colour: each node has one colour, so one search serves all.
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        home = settled(reach(back, colour.where("id = colour").select("id")).join(colour, "id").select("id", F.col("colour").alias("component")))
        two = home.groupBy("component").count().where("count > 1").select("component")
        found.add(home.join(two, "component", "left_semi").select("id", "component"))
        rest = inner.join(home.select(F.col("id").alias("src")), "src", "left_anti").join(home.select(F.col("id").alias("dst")), "dst", "left_anti")
        core = trimmed(rest.select("src", "dst"))
    raise RuntimeError("the strong components did not settle")


def _colours(edges: DataFrame) -> DataFrame:
    """id, colour: the smallest node that reaches it, itself included."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    colour = settled(nodes.withColumn("colour", F.col("id")))
    front = colour
    for _ in range(MAX_ROUNDS):
        near = front.join(edges.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
        step = settled(colour.join(near, "id", "left").select("id", F.least("colour", "near").alias("colour"), F.col("colour").alias("was")))
        front, colour = step.where("colour < was").select("id", "colour"), step.select("id", "colour")
        if front.isEmpty():
            return colour
    raise RuntimeError("the graph is deeper than MAX_ROUNDS")


def _longest(rows: pd.DataFrame) -> pd.DataFrame:
    """id, level of one block: nodes (dst null) with what is known of their level, arcs between them; null on a cycle."""
    known, arcs = rows[rows["dst"].isna()], rows[rows["dst"].notna()]
    ids = pd.Index(known["id"])
    level = known["level"].to_numpy(np.int64).copy()
    src, dst = ids.get_indexer(arcs["id"]), ids.get_indexer(arcs["dst"].astype(ids.dtype))
    src = src[np.argsort(dst, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=len(ids)))])
    waits = np.bincount(src, minlength=len(ids))
    front = np.flatnonzero(waits == 0)
    while len(front):
        size = ends[front + 1] - ends[front]
        at = np.repeat(ends[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
        np.maximum.at(level, src[at], np.repeat(level[front] + 1, size))
        np.subtract.at(waits, src[at], 1)
        met = np.unique(src[at])
        front = met[waits[met] == 0]
    out = pd.DataFrame({"id": known["id"].to_numpy(), "level": pd.array(level, "Int32")})
    out.loc[waits > 0, "level"] = pd.NA
    return out


def levels(edges: DataFrame, order: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """id, level of an acyclic graph: the longest path that leads from a node; sinks are 0.

    Nodes are dealt, in the order of ``order`` (id, key), into blocks of some ``block`` arcs; a task
    follows all paths inside a block, and a round hands on what grew to the blocks before. Any
    order gives the levels; one that arcs follow, as of ``arcs.feedback_arcs``, needs no more
    rounds than there are blocks, however long the paths are.
    """
    step = settled(edges.select("src", "dst").distinct(), "level-arcs")
    key = step.select("src", F.col("src").alias("key")).distinct() if order is None else order.select(F.col("id").alias("src"), "key")
    blocks = step.count() // block + 1
    dealt = step.join(key, "src", "left").repartitionByRange(blocks, "key", "src").withColumn("block", F.spark_partition_id())
    dealt = settled(dealt.select("src", "dst", "block"), "level-blocks")
    # A node's arcs have one key and lie in one block.
    nodes = settled(dealt.groupBy(F.col("src").alias("id")).agg(F.min("block").alias("block")), "level-nodes")
    arcs = settled(dealt.join(nodes.select(F.col("id").alias("dst"), F.col("block").alias("other")), "dst"), "level-arcs")
    inner, outer = arcs.where("block = other").select("block", F.col("src").alias("id"), "dst", F.lit(0).alias("level")), arcs.where("block <> other")
    now, most = nodes.select("id", "block", F.lit(1).alias("level"), F.lit(0).alias("told")), nodes.count()
    kind = f"id {nodes.schema['id'].dataType.simpleString()}, level int"
    for _ in range(MAX_ROUNDS):
        grown = now.where("level > told").select("block").distinct()
        tasks = now.select("block", "id", F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), "level").unionByName(inner).join(grown, "block", "left_semi")
        found = settled(tasks.groupBy("block").applyInPandas(_longest, kind), "level-found")
        if not found.where(F.col("level").isNull() | (F.col("level") > most)).isEmpty():
            raise RuntimeError("the graph has a cycle")
        now = now.join(found.withColumnRenamed("level", "found"), "id", "left").select("id", "block", F.coalesce("found", "level").alias("level"), "told")
        news = now.where("level > told").select(F.col("id").alias("dst"), "level")
        floor = outer.join(news, "dst").groupBy(F.col("src").alias("id")).agg((F.max("level") + 1).alias("floor"))
        now = settled(now.join(floor, "id", "left").select("id", "block", F.greatest("level", "floor").alias("level"), F.col("level").alias("told")), "levels")
        if now.where("level > told").isEmpty():
            sinks = step.select(F.col("dst").alias("id")).distinct().join(nodes, "id", "left_anti")
            return now.select("id", "level").unionByName(sinks.withColumn("level", F.lit(0)))
    raise RuntimeError("the graph is deeper than MAX_ROUNDS")

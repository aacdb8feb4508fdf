"""Clusters of a weighted graph by modularity.

With m the weight of all edges, k of a node's edges and K of a cluster's, moving a node v from A to
B changes modularity by ``(w(v, B) - w(v, A)) / m - k (K_B - K_A + k) / (2 m^2)``. Times 2 m^2 it is
a whole number, and whole numbers decide here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import graph
from loomery.session import settled

#: Rounds of moves of single nodes after the clusters have grown.
REFINE = 6


def _moved(edges: DataFrame, node: DataFrame, m: int, turn: int) -> tuple[DataFrame, bool]:
    """(id, k, cluster after one round of moves, whether any move gains). ``edges`` have both directions.

    A hash of cluster and turn halves the clusters: nodes leave those of one half for those of the
    other, each by its best move. Others that enter the same cluster or leave the same one first
    cost a move at most its k times theirs, so a move is made if it gains even after all of them,
    or if it is the best on both sides and made before them. Modularity cannot fall.
    """
    size = node.groupBy("cluster").agg(F.sum("k").alias("total"))
    own = edges.join(node.select(F.col("id").alias("dst"), F.col("cluster").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    held = node.join(size, "cluster")
    stay = own.join(node.select("id", "cluster"), "id").where("to = cluster").select("id", F.col("w").alias("inside"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    tries = own.join(held.select("id", "k", "cluster", F.col("total").alias("from_total")), "id").where("to <> cluster").join(stay, "id", "left").fillna(0, ["inside"])
    tries = tries.join(size.select(F.col("cluster").alias("to"), F.col("total").alias("to_total")), "to")
    gain = (whole("w") - whole("inside")) * (2 * m) - whole("k") * (whole("to_total") - whole("from_total") + whole("k"))
    tries = tries.withColumn("gain", gain.cast("decimal(38,0)")).where("gain > 0")
    half = lambda c: F.xxhash64(c, F.lit(turn)).bitwiseAND(F.lit(1))
    open_ = (half("cluster") == 0) & (half("to") == 1)
    move = F.max(F.when(open_, F.struct("gain", "to"))).alias("best")
    best = settled(tries.groupBy("id", "cluster", "k").agg(move).select("id", "cluster", "k", F.col("best.to").alias("to"), F.col("best.gain").alias("gain")), "moves")
    asked = best.where("to is not null")
    sides = asked.select(F.explode(F.array("cluster", "to")).alias("c"), "k", F.struct("gain", "id").alias("move"))
    sides = settled(sides.groupBy("c").agg(F.sum("k").alias("all"), F.max("move").alias("top")).select("c", "all", F.col("top.id").alias("top")), "moves")
    out, into = (sides.select(F.col("c").alias(c), F.col("all").alias(f"all_{c}"), F.col("top").alias(f"top_{c}")) for c in ("cluster", "to"))
    rated = asked.join(out, "cluster").join(into, "to")
    after = F.col("gain") - whole("k") * (whole("all_cluster") + whole("all_to") - whole("k") * 2)
    made = rated.where((after > 0) | ((F.col("top_cluster") == F.col("id")) & (F.col("top_to") == F.col("id")))).select("id", "to")
    done = node.join(made, "id", "left").select("id", "k", F.coalesce("to", "cluster").alias("cluster"))
    return settled(done, "clusters"), not best.isEmpty()


def clusters(edges: DataFrame) -> DataFrame:
    """id, cluster (the smallest id in it) of the nodes of ``edges`` (src, dst, w), directions aside.

    Nodes join first: a round lets single clusters move to one another and contracts what moved
    into one node, until no move gains. Then single nodes move between the clusters, REFINE rounds
    at most. Edges from a node to itself count for its cluster.
    """
    both = edges.select("src", "dst", F.col("w").cast("long").alias("w"))
    flat = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    flat = settled(flat.groupBy("src", "dst").agg(F.sum("w").alias("w")), "cluster-edges")
    m = int(both.agg(F.sum("w").alias("m")).head()["m"] or 0)
    degree = settled(flat.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "cluster-nodes")
    named = degree.select("id", F.col("id").alias("cluster"))
    level, node = flat, degree.select("id", "k", F.col("id").alias("cluster"))
    for turn in range(graph.MAX_ROUNDS):
        node, gains = _moved(level.where("src <> dst"), node, m, turn)
        if not gains:
            break
        named = settled(named.join(node.select(F.col("id").alias("cluster"), F.col("cluster").alias("now")), "cluster").select("id", F.col("now").alias("cluster")), "clusters")
        of = node.select("id", "cluster")
        level = level.join(of.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
        level = settled(level.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "cluster-edges")
        node = settled(node.groupBy(F.col("cluster").alias("id")).agg(F.sum("k").alias("k")).withColumn("cluster", F.col("id")), "cluster-nodes")
    node = degree.join(named, "id")
    for turn in range(REFINE):
        node, gains = _moved(flat.where("src <> dst"), node, m, turn)
        if not gains:
            break
    first = node.groupBy("cluster").agg(F.min("id").alias("first"))
    return settled(node.join(first, "cluster").select("id", F.col("first").alias("cluster")), "clusters")

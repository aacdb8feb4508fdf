"""Reachability, liveness, cycles and impact over the reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import graph
from loomery.plans.registry import query
from loomery.session import settled
from loomery.sources.facts import files, in_dir, live_refs, refs

REACH = """reach(id) AS (
    SELECT id FROM file WHERE role = 'entry' UNION SELECT live.dst FROM reach JOIN live ON live.src = reach.id
)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("role = 'entry'").select("id")


@query(f"WITH {REACH} SELECT id, path FROM file WHERE id IN (SELECT id FROM reach)", facts=True)
def reachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = graph.reach(live_refs(refs(spark, sf_dir)), _entries(spark, sf_dir))
    return files(spark, sf_dir).join(alive, "id", "left_semi").select("id", "path")


@query(
    f"""WITH {REACH}
       SELECT id, CASE WHEN id IN (SELECT dst FROM ref) THEN 'unref_private' ELSE 'unref_public' END AS verdict
       FROM file WHERE id NOT IN (SELECT id FROM reach)""",
    facts=True,
)
def dead_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no entry reaches; private if some file names them all the same."""
    r = settled(refs(spark, sf_dir))
    alive = graph.reach(live_refs(r), _entries(spark, sf_dir))
    named = r.select(F.col("dst").alias("id")).distinct().withColumn("named", F.lit(True))
    dead = files(spark, sf_dir).select("id").join(alive, "id", "left_anti").join(named, "id", "left")
    return dead.select("id", F.when(F.col("named"), "unref_private").otherwise("unref_public").alias("verdict"))


@query(
    f"""WITH {REACH}, dead AS (SELECT id FROM file WHERE id NOT IN (SELECT id FROM reach)),
       inner_ref AS (SELECT src, dst FROM live WHERE src IN (SELECT id FROM dead) AND dst IN (SELECT id FROM dead) AND src <> dst),
       root AS (SELECT id FROM dead WHERE id NOT IN (SELECT dst FROM inner_ref)),
       under(root, id) AS (SELECT id, id FROM root UNION SELECT under.root, inner_ref.dst FROM under JOIN inner_ref ON inner_ref.src = under.id)
       SELECT root, count(*) - 1 AS dependents FROM under GROUP BY root""",
    facts=True,
)
def dead_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead files that no dead file supports, and how many dead files hang under each."""
    edges = settled(live_refs(refs(spark, sf_dir)))
    alive = graph.reach(edges, _entries(spark, sf_dir))
    dead = settled(files(spark, sf_dir).select("id").join(alive, "id", "left_anti"))
    inner = edges.where("src <> dst").join(dead.withColumnRenamed("id", "src"), "src", "left_semi")
    inner = settled(inner.join(dead.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    roots = settled(dead.join(inner.select(F.col("dst").alias("id")), "id", "left_anti"))
    under = graph.closure(inner, roots).where("src <> dst")
    n = under.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return roots.join(n, "id", "left").select(F.col("id").alias("root"), F.coalesce("n", F.lit(0)).cast("long").alias("dependents"))


@query(
    """WITH top AS (SELECT id, split_part(path, '/', 1) AS top FROM file),
       depends(top, id) AS (SELECT top, dst FROM live JOIN top ON top.id = src UNION SELECT depends.top, live.dst FROM depends JOIN live ON live.src = depends.id)
       SELECT depends.top AS src, depends.id AS dst FROM depends JOIN top ON top.id = depends.id WHERE top.top <> depends.top""",
    facts=True,
)
def depends_across_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a top directory depends on, directly or through others, outside of it.

    The pairs are of a top directory and a file, not of two files: a row per file and module at most.
    """
    top = settled(files(spark, sf_dir).select("id", F.substring_index("path", "/", 1).alias("top")))
    edges = settled(live_refs(refs(spark, sf_dir)))
    first = edges.join(top.withColumnRenamed("id", "src"), "src").select("top", F.col("dst").alias("id"))
    found = graph.labelled_reach(edges, first.withColumnRenamed("top", "label"))
    return found.join(top, "id").where("label <> top").select(F.col("label").alias("src"), F.col("id").alias("dst"))


@query(
    """WITH r AS (SELECT DISTINCT a.dir AS src, b.dir AS dst FROM ref JOIN in_dir a ON a.id = ref.src JOIN in_dir b ON b.id = ref.dst WHERE a.dir <> b.dir),
       far(src, dst) AS (SELECT src, dst FROM r UNION SELECT far.src, r.dst FROM far JOIN r ON r.src = far.dst),
       mutual AS (SELECT a.src, a.dst FROM far a JOIN far b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
       SELECT src AS dir, least(src, min(dst)) AS cycle, count(*) + 1 AS size FROM mutual GROUP BY src""",
    facts=True,
)
def pack_no_dir_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that reach each other over references of any kind, with their cycle's first directory and size.

    Any two directories of one cycle are a pair that the rule forbids; the pairs, as many as the
    square of a cycle, are not spelled out.
    """
    d = in_dir(files(spark, sf_dir))
    r = refs(spark, sf_dir).select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("dir").alias("a")), "src")
    r = r.join(d.select(F.col("id").alias("dst"), F.col("dir").alias("b")), "dst").where("a <> b")
    found = graph.strong_components(r.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("id").alias("dir"), F.col("component").alias("cycle"), "size")


@query(
    """WITH r AS (SELECT DISTINCT src, dst FROM ref),
       far(src, dst) AS (SELECT src, dst FROM r UNION SELECT far.src, r.dst FROM far JOIN r ON r.src = far.dst),
       mutual AS (SELECT a.src, a.dst FROM far a JOIN far b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
       SELECT src AS id, least(src, min(dst)) AS component, count(*) + 1 AS size FROM mutual GROUP BY src""",
    facts=True,
)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(refs(spark, sf_dir))


@query(
    """WITH e AS (SELECT src AS x, dst AS y FROM ref UNION SELECT dst, src FROM ref),
       near(x, y) AS (SELECT x, x FROM e UNION SELECT near.x, e.y FROM near JOIN e ON e.x = near.y)
       SELECT x AS id, min(y) AS component FROM near GROUP BY x""",
    facts=True,
)
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(refs(spark, sf_dir))


@query(
    """WITH walk(id, depth) AS (
           SELECT id, 0 FROM file WHERE role = 'test' UNION SELECT ref.src, walk.depth + 1 FROM walk JOIN ref ON ref.dst = walk.id WHERE walk.depth < 60
       ) SELECT id, min(depth) AS depth FROM walk GROUP BY id""",
    facts=True,
)
def impact_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references back a change in a focus file (role test) is felt."""
    back = refs(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.depths(back, files(spark, sf_dir).where("role = 'test'").select("id"))


@query(
    """WITH walk(id, depth) AS (
           SELECT id, 0 FROM file WHERE role = 'entry' UNION SELECT live.dst, walk.depth + 1 FROM walk JOIN live ON live.src = walk.id WHERE walk.depth < 60
       ), d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
       SELECT d.id, d.depth, CASE WHEN d.depth = 0 THEN 'entry' ELSE 'ref' END AS rule, min(p.id) AS parent
       FROM d LEFT JOIN (live JOIN d p ON p.id = live.src) ON live.dst = d.id AND p.depth = d.depth - 1 GROUP BY d.id, d.depth""",
    facts=True,
)
def proof_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest derivation of every reachable file: its rule and the file it follows from."""
    edges = settled(live_refs(refs(spark, sf_dir)))
    d = graph.depths(edges, _entries(spark, sf_dir))
    via = edges.join(d.select(F.col("id").alias("src"), F.col("depth").alias("before")), "src").select(F.col("dst").alias("id"), "src", "before")
    out = d.join(via, "id", "left").groupBy("id", "depth").agg(F.min(F.when(F.col("before") == F.col("depth") - 1, F.col("src"))).alias("parent"))
    return out.select("id", "depth", F.when(F.col("depth") == 0, "entry").otherwise("ref").alias("rule"), "parent")


ORDERED = "down AS (SELECT DISTINCT src, dst FROM live WHERE src < dst)"


@query(
    f"""WITH {ORDERED}, walk(id, level) AS (
           SELECT src, 0 FROM down UNION SELECT dst, 0 FROM down UNION SELECT down.src, walk.level + 1 FROM walk JOIN down ON down.dst = walk.id
       ) SELECT id, max(level) AS level FROM walk GROUP BY id""",
    facts=True,
)
def layer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest path below each file once the references that point back (dst before src) are cut."""
    return graph.levels(live_refs(refs(spark, sf_dir)).where("src < dst"))

"""Directory structure, coupling and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import shape_bits
from loomery.operators import graph
from loomery.plans.registry import query
from loomery.sources.facts import files, in_dir, live_refs, ref_tasks, refs
from loomery.sources.tables import table


def directories(file: DataFrame) -> DataFrame:
    """id, dir for every directory above each file, the root as the empty string."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), "/")).otherwise(""))
    return file.select("id", F.explode(up).alias("dir"))


TREE = """d AS (
    SELECT DISTINCT list_aggregate(list_slice(string_split(path, '/'), 1, k), 'string_agg', '/') AS dir, k::INTEGER AS depth
    FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS k FROM file) WHERE k > 0
    UNION SELECT '', 0
)"""


@query(
    f"""WITH {TREE}
       SELECT d.dir, d.depth,
              CASE WHEN d.depth > 1 THEN regexp_replace(d.dir, '/[^/]*$', '') ELSE '' END AS parent,
              (SELECT count(*) FROM d c WHERE c.depth = d.depth + 1 AND (d.depth = 0 OR c.dir LIKE d.dir || '/%')) AS subdirs,
              (SELECT count(*) FROM in_dir f WHERE f.dir = d.dir) AS files
       FROM d""",
    facts=True,
)
def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory with its depth, parent (the root is its own), subdirectories and own files."""
    f = files(spark, sf_dir)
    d = directories(f).select("dir").distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    parent = F.when(depth > 1, F.regexp_replace("dir", "/[^/]*$", "")).otherwise("")
    d = d.select("dir", depth.alias("depth"), parent.alias("parent"))
    sub = d.where("depth > 0").groupBy(F.col("parent").alias("dir")).agg(F.count("*").alias("subdirs"))
    own = in_dir(f).groupBy("dir").agg(F.count("*").alias("files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return d.join(sub, "dir", "left").join(own, "dir", "left").select("dir", "depth", "parent", zero("subdirs"), zero("files"))


@query(
    r"""WITH s AS (SELECT id, regexp_extract(path, '([^/]*)$', 1) AS base FROM file),
       t AS (SELECT id, CASE WHEN base LIKE '%.%' THEN split_part(base, '.', 1) ELSE base END AS stem FROM s)
       SELECT dir, ((CASE WHEN stem LIKE '%\_%' ESCAPE '\' THEN 1 ELSE 0 END) + (CASE WHEN stem LIKE '%-%' THEN 2 ELSE 0 END)
            + (CASE WHEN regexp_matches(stem, '[a-z]') THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(stem, '[A-Z]') THEN 8 ELSE 0 END)
            + (CASE WHEN regexp_matches(stem, '^[0-9]') THEN 16 ELSE 0 END) + (CASE WHEN regexp_matches(stem, '^[A-Z]') THEN 32 ELSE 0 END)
            + (CASE WHEN regexp_matches(stem, '[^A-Za-z0-9_-]') THEN 64 ELSE 0 END))::INTEGER AS bits, count(*) AS n
       FROM t JOIN in_dir USING (id) GROUP BY ALL""",
    facts=True,
)
def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name shape occurs in each directory."""
    f = files(spark, sf_dir).select("id", "path", F.substring_index(F.regexp_extract("path", "([^/]*)$", 1), ".", 1).alias("stem"))
    return in_dir(f).join(f.select("id", shape_bits(F.col("stem")).alias("bits")), "id").groupBy("dir", "bits").agg(F.count("*").alias("n"))


def placed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, dir_a, dir_b of every reference row between two files, in tasks that grow with the references."""
    d, n = in_dir(files(spark, sf_dir)), ref_tasks(spark, sf_dir)
    r = refs(spark, sf_dir).where("src <> dst").select("src", "dst")
    for end, dir_ in (("src", "dir_a"), ("dst", "dir_b")):
        r = r.repartition(n, end).join(d.select(F.col("id").alias(end), F.col("dir").alias(dir_)).repartition(n, end).hint("merge"), end)
    return r.select("src", "dst", "dir_a", "dir_b")


def crossed(placed: DataFrame) -> DataFrame:
    """dir_a, dir_b, n: references from one directory to another."""
    return placed.where("dir_a <> dir_b").groupBy("dir_a", "dir_b").agg(F.count("*").alias("n"))


PLACED = "placed AS (SELECT src, dst, a.dir AS dir_a, b.dir AS dir_b FROM ref JOIN in_dir a ON a.id = src JOIN in_dir b ON b.id = dst WHERE src <> dst)"


@query(
    f"""WITH {PLACED}, ends AS (SELECT src AS id, dir_a = dir_b AS inside FROM placed UNION ALL SELECT dst, dir_a = dir_b FROM placed)
       SELECT id, count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE NOT inside) AS n_outside FROM ends GROUP BY id""",
    facts=True,
)
def ref_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file, references inside its directory and across; both ends count."""
    p = placed_refs(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("id"), (F.col("dir_a") == F.col("dir_b")).alias("inside"))
    return p.groupBy("id").agg(F.count_if("inside").alias("n_inside"), F.count_if(~F.col("inside")).alias("n_outside"))


@query(f"WITH {PLACED} SELECT dir_a, dir_b, count(*) AS n FROM placed WHERE dir_a <> dir_b GROUP BY ALL", facts=True)
def dir_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossed(placed_refs(spark, sf_dir))


@query(
    f"""WITH {PLACED}, o AS (SELECT dir_a AS dir, count(DISTINCT dir_b) AS n_out FROM placed WHERE dir_a <> dir_b GROUP BY 1),
       i AS (SELECT dir_b AS dir, count(DISTINCT dir_a) AS n_in FROM placed WHERE dir_a <> dir_b GROUP BY 1)
       SELECT dir, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in,
              coalesce(n_out, 0) / (coalesce(n_out, 0) + coalesce(n_in, 0))::DOUBLE AS instability FROM o FULL JOIN i USING (dir)""",
    facts=True,
)
def dir_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-out, fan-in and instability of each directory."""
    p = placed_refs(spark, sf_dir).where("dir_a <> dir_b")
    o = p.groupBy(F.col("dir_a").alias("dir")).agg(F.countDistinct("dir_b").alias("n_out"))
    i = p.groupBy(F.col("dir_b").alias("dir")).agg(F.countDistinct("dir_a").alias("n_in"))
    z = o.join(i, "dir", "full").select("dir", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"))
    return z.withColumn("instability", F.col("n_out") / (F.col("n_out") + F.col("n_in")).cast("double"))


@query(
    f"""WITH {PLACED}, m AS (SELECT count(*) AS m FROM placed),
       g AS (SELECT dir, sum(own)::BIGINT AS links, sum(o)::BIGINT AS k_out, sum(i)::BIGINT AS k_in FROM (
           SELECT dir_a AS dir, (dir_a = dir_b)::INT AS own, 1 AS o, 0 AS i FROM placed UNION ALL SELECT dir_b, 0, 0, 1 FROM placed) GROUP BY dir)
       SELECT dir, links, k_out, k_in, m * links - k_in * k_out AS gain, m * links - k_in * k_out < 0 AS grab_bag FROM g, m""",
    facts=True,
)
def dir_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directory's share of modularity, times m squared: m L - k_in k_out; below zero is a grab bag."""
    p = placed_refs(spark, sf_dir)
    own = (F.col("dir_a") == F.col("dir_b")).cast("int")
    ends = p.select(F.col("dir_a").alias("dir"), own.alias("own"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.unionAll(p.select("dir_b", F.lit(0), F.lit(0), F.lit(1)))
    g = ends.groupBy("dir").agg(F.sum("own").alias("links"), F.sum("o").alias("k_out"), F.sum("i").alias("k_in"))
    m = p.agg(F.count("*").alias("m"))  # one row
    gain = F.col("m") * F.col("links") - F.col("k_in") * F.col("k_out")
    return g.join(F.broadcast(m)).select("dir", "links", "k_out", "k_in", gain.alias("gain"), (gain < 0).alias("grab_bag"))


@query(
    """WITH clone AS (SELECT p_name || ' ' || p_type AS k, p_partkey AS id FROM part),
       block AS (SELECT k, id FROM clone WHERE k IN (SELECT k FROM clone GROUP BY k HAVING count(*) >= 2)),
       a AS (SELECT dir, count(DISTINCT k) AS clone_blocks FROM block JOIN in_dir USING (id) GROUP BY dir),
       reach(id) AS (SELECT id FROM file WHERE role = 'entry' UNION SELECT live.dst FROM reach JOIN live ON live.src = reach.id),
       b AS (SELECT dir, count(*) AS dead FROM in_dir WHERE id NOT IN (SELECT id FROM reach) GROUP BY dir)
       SELECT dir, coalesce(clone_blocks, 0) AS clone_blocks, coalesce(dead, 0) AS dead FROM a FULL JOIN b USING (dir)""",
    facts=True,
)
def redundancy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per directory, clone blocks (once per directory they touch) and files that no entry reaches.

    A block has two members or more, however many.
    """
    f = files(spark, sf_dir)
    d = in_dir(f)
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("k"))
    blocks = c.join(c.groupBy("k").count().where("count >= 2").select("k"), "k", "left_semi")
    a = blocks.join(d, "id").groupBy("dir").agg(F.countDistinct("k").alias("clone_blocks"))
    alive = graph.reach(live_refs(refs(spark, sf_dir)), f.where("role = 'entry'").select("id"))
    b = d.join(alive, "id", "left_anti").groupBy("dir").agg(F.count("*").alias("dead"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return a.join(b, "dir", "full").select("dir", zero("clone_blocks"), zero("dead"))


@query(
    """WITH ts AS (SELECT l_partkey AS id, max(o_orderdate) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT src, count(*) AS n_targets, count(*) FILTER (WHERE b.at > a.at) AS n_stale
       FROM (SELECT DISTINCT src, dst FROM ref WHERE kind = 'doc_link') r JOIN ts a ON a.id = src JOIN ts b ON b.id = dst GROUP BY src""",
    facts=True,
)
def doc_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose targets changed after them: strictly newer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    ts = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").groupBy(F.col("l_partkey").alias("id")).agg(F.max("o_orderdate").alias("at"))
    r = refs(spark, sf_dir).where("kind = 'doc_link'").select("src", "dst").distinct()
    r = r.join(ts.select(F.col("id").alias("src"), F.col("at").alias("a")), "src").join(ts.select(F.col("id").alias("dst"), F.col("at").alias("b")), "dst")
    return r.groupBy("src").agg(F.count("*").alias("n_targets"), F.count_if(F.col("b") > F.col("a")).alias("n_stale"))

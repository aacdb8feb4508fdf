"""Rule bodies as plans: selection, joins, negation, union, arithmetic, aggregates over sets.

Heads are sets, so every projection ends in ``distinct``; aggregates count distinct bindings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.plans.registry import query
from loomery.sources.facts import files, in_dir, refs


@query("SELECT DISTINCT src, dst FROM ref WHERE kind = 'import'", facts=True)
def dl_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).where("kind = 'import'").select("src", "dst").distinct()


@query("SELECT DISTINCT src, dst, lines FROM ref JOIN file ON file.id = dst WHERE lines > 10", facts=True)
def dl_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("lines > 10").select(F.col("id").alias("dst"), "lines")
    return refs(spark, sf_dir).join(f, "dst").select("src", "dst", "lines").distinct()


@query(
    """SELECT DISTINCT a.dir AS dir_a, b.dir AS dir_b FROM ref JOIN in_dir a ON a.id = src JOIN in_dir b ON b.id = dst
       WHERE a.dir < b.dir""",
    facts=True,
)
def dl_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = in_dir(files(spark, sf_dir))
    a, b = d.select(F.col("id").alias("src"), F.col("dir").alias("dir_a")), d.select(F.col("id").alias("dst"), F.col("dir").alias("dir_b"))
    return refs(spark, sf_dir).join(a, "src").join(b, "dst").where("dir_a < dir_b").select("dir_a", "dir_b").distinct()


@query("SELECT id, path FROM file WHERE id NOT IN (SELECT dst FROM ref WHERE kind = 'import')", facts=True)
def dl_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = refs(spark, sf_dir).where("kind = 'import'").select(F.col("dst").alias("id"))
    return files(spark, sf_dir).join(used, "id", "left_anti").select("id", "path")


@query("SELECT id, path FROM file WHERE id IN (SELECT src FROM ref WHERE rung >= 3)", facts=True)
def dl_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = refs(spark, sf_dir).where("rung >= 3").select(F.col("src").alias("id"))
    return files(spark, sf_dir).join(used, "id", "left_semi").select("id", "path")


@query("SELECT src AS id FROM ref UNION SELECT dst FROM ref UNION SELECT id FROM file WHERE role = 'entry'", facts=True)
def dl_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = refs(spark, sf_dir)
    entry = files(spark, sf_dir).where("role = 'entry'").select("id")
    return r.select(F.col("src").alias("id")).union(r.select("dst")).union(entry).distinct()


@query(
    """SELECT DISTINCT src, dst, a.lines - b.lines AS gap, (a.lines - b.lines) // 3 AS third, (a.lines - b.lines) % 3 AS rest
       FROM ref JOIN file a ON a.id = src JOIN file b ON b.id = dst""",
    facts=True,
)
def dl_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    r = refs(spark, sf_dir).join(f.select(F.col("id").alias("src"), F.col("lines").alias("x")), "src")
    r = r.join(f.select(F.col("id").alias("dst"), F.col("lines").alias("y")), "dst").withColumn("gap", F.col("x") - F.col("y"))
    third, rest = F.expr("cast(gap div 3 as int)"), F.col("gap") % 3
    return r.select("src", "dst", "gap", third.alias("third"), rest.alias("rest")).distinct()


@query("SELECT src AS id FROM ref WHERE src = dst UNION SELECT a.src FROM ref a JOIN ref b ON a.src = b.dst AND a.dst = b.src", facts=True)
def dl_repeated_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = refs(spark, sf_dir).select("src", "dst").distinct()
    back = r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = r.where("src = dst").select(F.col("src").alias("id"))
    return own.union(r.join(back, ["src", "dst"], "left_semi").select("src")).distinct()


@query(
    """SELECT dir, count(DISTINCT id) AS n_files, min(lines) AS least, max(lines) AS most, sum(lines)::BIGINT AS total
       FROM file JOIN in_dir USING (id) GROUP BY dir""",
    facts=True,
)
def dl_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    g = f.join(in_dir(f), "id").groupBy("dir")
    return g.agg(F.countDistinct("id").alias("n_files"), F.min("lines").alias("least"), F.max("lines").alias("most"), F.sum("lines").alias("total"))


@query("SELECT id, (SELECT count(DISTINCT dst) FROM ref WHERE src = id) AS n_used FROM file", facts=True)
def dl_correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over a body that shares an outer variable: grouped by it, 0 where nothing binds."""
    n = refs(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_used"))
    return files(spark, sf_dir).select("id").join(n, "id", "left").select("id", F.coalesce("n_used", F.lit(0)).cast("long").alias("n_used"))


def over(edges: DataFrame, key: str, other: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` distinct others, and how many."""
    g = edges.where(f"{key} <> {other}").groupBy(F.col(key).alias("id")).agg(F.countDistinct(other).alias("n"))
    return g.where(F.col("n") > limit)


@query("SELECT dst AS id, count(DISTINCT src) AS n FROM ref WHERE src <> dst GROUP BY dst HAVING count(DISTINCT src) > 2", facts=True)
def pack_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(refs(spark, sf_dir), "dst", "src", 2)


@query("SELECT src AS id, count(DISTINCT dst) AS n FROM ref WHERE src <> dst GROUP BY src HAVING count(DISTINCT dst) > 2", facts=True)
def pack_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(refs(spark, sf_dir), "src", "dst", 2)


#: Layers from the top down, as path patterns of the carrier's directories.
LAYERS = ("^brand[0-9]/", "^brand1[0-9]/", "^brand2[0-9]/")


@query(
    """WITH layer AS (SELECT id, CASE WHEN regexp_matches(path, '^brand[0-9]/') THEN 0 WHEN regexp_matches(path, '^brand1[0-9]/') THEN 1
                          WHEN regexp_matches(path, '^brand2[0-9]/') THEN 2 END AS layer FROM file)
       SELECT DISTINCT src, dst, a.layer AS from_layer, b.layer AS to_layer FROM ref JOIN layer a ON a.id = src JOIN layer b ON b.id = dst
       WHERE a.layer > b.layer""",
    facts=True,
)
def pack_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from a lower layer to a higher one; the first pattern that matches owns a path."""
    layer = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(i)) for i, p in enumerate(LAYERS)])
    f = files(spark, sf_dir).select("id", layer.alias("layer"))
    r = refs(spark, sf_dir).join(f.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), "src")
    r = r.join(f.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    return r.where("from_layer > to_layer").select("src", "dst", "from_layer", "to_layer").distinct()


@query(
    """SELECT DISTINCT src, dst FROM ref JOIN file a ON a.id = src JOIN file b ON b.id = dst
       WHERE a.path LIKE '%/widget-%' AND b.path LIKE '%/bolt-%'""",
    facts=True,
)
def pack_forbid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    a = f.where("path like '%/widget-%'").select(F.col("id").alias("src"))
    b = f.where("path like '%/bolt-%'").select(F.col("id").alias("dst"))
    return refs(spark, sf_dir).join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst").distinct()

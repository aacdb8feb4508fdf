"""Nodes and containment of the reference graph, conventions, budgets by directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.plans.pages import PAGES, links, targets
from loomery.plans.registry import query
from loomery.plans.structure import PLACED, directories, ref_participation
from loomery.sources.facts import files, in_dir, live_refs, refs
from loomery.sources.tables import table

#: Soft and hard line of a directory's size, in lines.
SOFT, HARD = 200, 450
#: Findings that a top directory may have on each axis.
ALLOWED = {"size": 2, "deadcode": 1, "clone": 3}


@query(
    """WITH e AS (SELECT src AS id, 0 AS n FROM ref UNION ALL SELECT dst, 1 FROM ref UNION ALL SELECT id, 0 FROM file)
       SELECT id, sum(n)::BIGINT AS n_refs, id NOT IN (SELECT id FROM file) AS asset FROM e GROUP BY id""",
    facts=True,
)
def node_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file and end of a reference, how often it is referenced, and whether it is an asset: a target that no file is."""
    r, f, none = refs(spark, sf_dir), files(spark, sf_dir).select("id"), F.lit(0)
    e = r.select(F.col("dst").alias("id"), F.lit(1).alias("n"), none.alias("held")).unionAll(r.select("src", none, none)).unionAll(f.select("id", none, F.lit(1)))
    return e.groupBy("id").agg(F.sum("n").alias("n_refs"), (F.max("held") == 0).alias("asset"))


@query(
    f"""WITH {PAGES}, t AS (SELECT host, regexp_replace(href, '[?#].*$', '') AS path, 1 AS n, 0 AS held FROM link JOIN page USING (page_id) WHERE href LIKE '/%'),
       e AS (SELECT * FROM t UNION ALL SELECT host, path, 0, 1 FROM page)
       SELECT host, path, sum(n)::BIGINT AS n_refs, max(held) = 1 AS held, path LIKE '%/' AS package, max(held) = 0 AND path NOT LIKE '%/' AS asset FROM e GROUP BY host, path"""
)
def link_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the targets of their links: a target that no page is is an asset, unless it names a directory."""
    pages = table(spark, sf_dir, "pages")
    own = targets(pages)
    t = links(pages).where(F.col("href").startswith("/")).join(own.select("page_id", "host"), "page_id")
    t = t.select("host", F.regexp_replace("href", "[?#].*$", "").alias("path"), F.lit(1).alias("n"), F.lit(0).alias("held"))
    g = t.unionByName(own.select("host", "path", F.lit(0).alias("n"), F.lit(1).alias("held"))).groupBy("host", "path").agg(F.sum("n").alias("n_refs"), (F.max("held") == 1).alias("held"))
    package = F.col("path").endswith("/")
    return g.select("host", "path", "n_refs", "held", package.alias("package"), (~F.col("held") & ~package).alias("asset"))


@query(
    """WITH p AS (SELECT id, string_split(path, '/') AS parts FROM file)
       SELECT id, array_to_string(parts[1:k], '/') AS dir FROM (SELECT id, parts, unnest(range(0, len(parts))) AS k FROM p)""",
    facts=True,
)
def containment_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory, the root included, with each file under it."""
    return directories(files(spark, sf_dir))


@query(
    """SELECT f.id, count(r.dst) AS n_unresolved, CASE WHEN count(r.dst) = 0 THEN 'full' WHEN count(r.dst) = 1 THEN 'some' ELSE 'low' END AS trust
       FROM file f LEFT JOIN ref r ON r.dst = f.id AND r.kind IN ('asset', 'refdef') WHERE f.role = 'plain' AND f.id NOT IN (SELECT dst FROM live) GROUP BY f.id""",
    facts=True,
)
def dead_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files that no live reference reaches; references that resolve to nothing lower the trust in that."""
    r = refs(spark, sf_dir)
    unsure = r.where(F.col("kind").isin("asset", "refdef")).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    dead = files(spark, sf_dir).where("role = 'plain'").join(live_refs(r).select(F.col("dst").alias("id")), "id", "left_anti").join(unsure, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return dead.select("id", n.cast("long").alias("n_unresolved"), F.when(n == 0, "full").when(n == 1, "some").otherwise("low").alias("trust"))


@query(
    """SELECT dir, bit_or(CASE WHEN path LIKE '%/ring-%' THEN 1 ELSE 0 END | CASE WHEN path LIKE '%/bolt-%' OR path LIKE '%/valve-%' THEN 2 ELSE 0 END)::INTEGER AS bits
       FROM file JOIN in_dir USING (id) GROUP BY dir""",
    facts=True,
)
def convention_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per directory, 1 if it holds a read-me (here: ring) and 2 if a known configuration (here: bolt, valve)."""
    f = files(spark, sf_dir)
    base = F.substring_index("path", "/", -1)
    bits = F.when(base.startswith("ring-"), 1).otherwise(0).bitwiseOR(F.when(base.rlike("^(bolt|valve)-"), 2).otherwise(0))
    return in_dir(f).join(f.select("id", bits.alias("bits")), "id").groupBy("dir").agg(F.bit_or("bits").alias("bits"))


@query(
    f"""WITH {PLACED}, ends AS (SELECT src AS id, dir_a = dir_b AS inside FROM placed UNION ALL SELECT dst, dir_a = dir_b FROM placed),
       p AS (SELECT id, count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE NOT inside) AS n_outside FROM ends GROUP BY id)
       SELECT dir, n_inside, n_outside, count(*) AS n FROM p JOIN in_dir USING (id) GROUP BY ALL""",
    facts=True,
)
def grouped_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of a directory have so many references inside it and so many across."""
    p = ref_participation(spark, sf_dir).join(in_dir(files(spark, sf_dir)), "id")
    return p.groupBy("dir", "n_inside", "n_outside").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT split_part(path, '/', 1) AS brand, split_part(path, '/', 2) AS part, lines FROM file),
       t AS (SELECT brand, sum(lines)::BIGINT AS total FROM s GROUP BY 1), c AS (SELECT brand, part, sum(lines)::BIGINT AS own FROM s GROUP BY ALL)
       SELECT brand, part, own, total, 10000 * (greatest(total - 200, 0) ** 2 - greatest(own - 200, 0) ** 2 - greatest(total - own - 200, 0) ** 2)::BIGINT // 62500 AS benefit
       FROM c JOIN t USING (brand)""",
    facts=True,
)
def split_benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moving a part out of its top directory saves, in thousandths.

    A size x costs 10 * ((x - soft) / (hard - soft))^2 above the soft line and nothing below.
    """
    s = files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("brand"), F.split("path", "/")[1].alias("part"), "lines")
    own = s.groupBy("brand", "part").agg(F.sum("lines").alias("own"))
    c = own.join(own.groupBy("brand").agg(F.sum("own").alias("total")), "brand")
    square = lambda x: F.greatest(x - SOFT, F.lit(0)) * F.greatest(x - SOFT, F.lit(0))
    c = c.withColumn("d", square(F.col("total")) - square(F.col("own")) - square(F.col("total") - F.col("own")))
    return c.select("brand", "part", "own", "total", F.expr(f"10000 * d div {(HARD - SOFT) ** 2}").alias("benefit"))


AXES = """axis AS (SELECT 'size' AS axis, id FROM file WHERE lines >= 45
       UNION ALL SELECT 'deadcode', id FROM file WHERE role <> 'entry' AND id NOT IN (SELECT dst FROM live)
       UNION ALL SELECT 'clone', id FROM (SELECT id, count(*) OVER (PARTITION BY regexp_replace(path, '-[0-9]+[.]src$', '')) AS n FROM file) WHERE n > 1),
       found AS (SELECT split_part(path, '/', 1) AS brand, axis, count(*) AS n FROM axis JOIN file USING (id) GROUP BY ALL)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, axis, n: findings of each axis per top directory."""
    f = files(spark, sf_dir).select("id", "lines", "role", F.substring_index("path", "/", 1).alias("brand"), F.regexp_replace("path", "-[0-9]+[.]src$", "").alias("name"))
    count = lambda d, axis: d.groupBy("brand").agg(F.lit(axis).alias("axis"), F.sum("one").alias("n"))
    one = f.withColumn("one", F.lit(1))
    dead = one.where("role <> 'entry'").join(live_refs(refs(spark, sf_dir)).select(F.col("dst").alias("id")), "id", "left_anti")
    twins = f.groupBy("brand", "name").agg(F.count("*").alias("one")).where("one > 1")
    return count(one.where("lines >= 45"), "size").unionAll(count(dead, "deadcode")).unionAll(count(twins, "clone"))


@query(f"WITH {AXES} SELECT brand, axis, n FROM found", facts=True)
def axis_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)


@query(
    f"""WITH {AXES} SELECT brand, sum(n)::BIGINT AS n, bool_or(n > CASE axis WHEN 'size' THEN 2 WHEN 'deadcode' THEN 1 ELSE 3 END) AS failed,
       count(*) FILTER (WHERE n > CASE axis WHEN 'size' THEN 2 WHEN 'deadcode' THEN 1 ELSE 3 END) AS n_failed FROM found GROUP BY brand""",
    facts=True,
)
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top directory fails if any axis has more findings than are allowed."""
    allowed = F.coalesce(*[F.when(F.col("axis") == a, n) for a, n in ALLOWED.items()])
    over = F.col("n") > allowed
    return findings(spark, sf_dir).groupBy("brand").agg(F.sum("n").alias("n"), F.bool_or(over).alias("failed"), F.count_if(over).alias("n_failed"))

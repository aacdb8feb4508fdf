"""Baselines, budgets, zones and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators.stats import clopper_pearson
from loomery.plans.registry import query
from loomery.sources.facts import files, in_dir, refs
from loomery.sources.tables import table

HALVES = """m AS (SELECT l_suppkey AS id, sum(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity END)::BIGINT AS base, sum(CASE WHEN l_orderkey % 2 = 1 THEN l_quantity END)::BIGINT AS now
       FROM lineitem GROUP BY 1)"""


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, base, now: a measure in two snapshots, null where one of them lacks the member."""
    q, even = F.col("l_quantity"), F.col("l_orderkey") % 2 == 0
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"))
    return g.agg(F.sum(F.when(even, q)).cast("long").alias("base"), F.sum(F.when(~even, q)).cast("long").alias("now"))


def ratchet(pair: DataFrame) -> DataFrame:
    """id, verdict, ceiling: what the baseline lacks is added, what is gone removed, growth past the ceiling over.

    The ceiling is the larger of 102 % of the baseline and ten above it.
    """
    ceiling = F.greatest(F.expr("base * 102 div 100"), F.col("base") + 10)
    verdict = F.when(F.col("base").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") > ceiling, "over").otherwise("held")
    return pair.select("id", verdict.alias("verdict"), ceiling.alias("ceiling"))


@query(
    f"""WITH {HALVES} SELECT id, CASE WHEN base IS NULL THEN 'added' WHEN now IS NULL THEN 'removed'
           WHEN now > greatest(base * 102 // 100, base + 10) THEN 'over' ELSE 'held' END AS verdict, greatest(base * 102 // 100, base + 10) AS ceiling FROM m"""
)
def ratchet_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratchet(halves(spark, sf_dir))


@query(
    """WITH v AS (SELECT l_orderkey AS f, l_linenumber AS v, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL),
       w AS (SELECT f, v, n, lag(n) OVER (PARTITION BY f ORDER BY v) AS before FROM v)
       SELECT f, v, CASE WHEN n > 40 AND n > before THEN CASE WHEN before > 40 THEN 'carried' ELSE 'crossing' END WHEN n > before THEN 'growth' ELSE 'ok' END AS kind
       FROM w WHERE before IS NOT NULL"""
)
def write_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive versions of a file against a cap of 40: carried above it, crossing it, growing below."""
    li = table(spark, sf_dir, "lineitem")
    v = li.groupBy(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("v")).agg(F.sum("l_quantity").cast("long").alias("n"))
    w = v.withColumn("before", F.lag("n").over(Window.partitionBy("f").orderBy("v"))).where("before is not null")
    grown, past = F.col("n") > F.col("before"), F.col("n") > 40
    kind = F.when(grown & past & (F.col("before") > 40), "carried").when(grown & past, "crossing").when(grown, "growth").otherwise("ok")
    return w.select("f", "v", kind.alias("kind"))


@query(
    """WITH z AS (SELECT p_partkey AS id, CASE WHEN p_size <= 20 THEN NULL ELSE (p_size - 20) * 1000 // 25 END AS permille FROM part)
       SELECT id, permille, CASE WHEN permille IS NULL THEN 'free' WHEN permille < 250 THEN 'observe' WHEN permille <= 750 THEN 'warn' ELSE 'ask' END AS zone FROM z"""
)
def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a size lies between the soft line (20) and the hard line (45)."""
    permille = F.when(F.col("p_size") > 20, F.expr("cast((p_size - 20) * 1000 div 25 as int)"))
    z = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), permille.alias("permille"))
    p = F.col("permille")
    return z.withColumn("zone", F.when(p.isNull(), "free").when(p < 250, "observe").when(p <= 750, "warn").otherwise("ask"))


@query(
    """WITH l AS (SELECT dir, ln(lines::DOUBLE) AS x FROM file JOIN in_dir USING (id) WHERE lines > 0),
       c AS (SELECT split_part(dir, '/', 1) AS brand, quantile_cont(x, 0.5) AS m FROM l GROUP BY 1),
       s AS (SELECT brand, m, quantile_cont(abs(x - m), 0.5) AS spread FROM l JOIN c ON split_part(dir, '/', 1) = brand GROUP BY ALL)
       SELECT brand, round(least(500, greatest(20, exp(m + 2 * spread))), 6) AS soft_line FROM s""",
    facts=True,
)
def soft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per top directory, the median size times the square of its multiplicative spread, within [20, 500]."""
    f = files(spark, sf_dir)
    x = in_dir(f).join(f.where("lines > 0"), "id").select(F.substring_index("dir", "/", 1).alias("brand"), F.ln(F.col("lines").cast("double")).alias("x"))
    m = x.groupBy("brand").agg(F.expr("percentile(x, 0.5)").alias("m"))
    s = x.join(m, "brand").groupBy("brand", "m").agg(F.expr("percentile(abs(x - m), 0.5)").alias("spread"))
    line = F.least(F.lit(500.0), F.greatest(F.lit(20.0), F.exp(F.col("m") + 2 * F.col("spread"))))
    return s.select("brand", F.round(line, 6).alias("soft_line"))


@query(
    """WITH e AS (SELECT id, unnest(range(greatest(1, lines - 12), lines + 1)) AS line FROM file WHERE lines > 20 UNION SELECT dst, unnest(range(1, rung + 1)) FROM ref),
       d AS (SELECT split_part(path, '/', 1) AS brand, id, lines FROM file), t AS (SELECT brand, sum(lines)::BIGINT AS total FROM d GROUP BY 1),
       n AS (SELECT brand, count(*) AS named FROM e JOIN d USING (id) WHERE line <= lines GROUP BY 1)
       SELECT brand, total, coalesce(named, 0) AS named, greatest(0, (1000 * total - 1000 * coalesce(named, 0)) // total) AS score FROM t LEFT JOIN n USING (brand)""",
    facts=True,
)
def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score per top directory: a thousand less the share of lines that findings name, each line once."""
    f = files(spark, sf_dir)
    lines = F.sequence(F.greatest(F.lit(1), F.col("lines") - 12), F.col("lines"))
    e = f.where("lines > 20").select("id", F.explode(lines).alias("line"))
    e = e.unionAll(refs(spark, sf_dir).select("dst", F.explode(F.sequence(F.lit(1), F.col("rung"))))).distinct()
    d = f.select("id", F.substring_index("path", "/", 1).alias("brand"), "lines")
    named = e.join(d, "id").where("line <= lines").groupBy("brand").agg(F.count("*").alias("named"))
    t = d.groupBy("brand").agg(F.sum("lines").alias("total")).join(named, "brand", "left").withColumn("named", F.coalesce("named", F.lit(0)).cast("long"))
    return t.select("brand", "total", "named", F.greatest(F.lit(0), F.expr("(1000 * total - 1000 * named) div total")).alias("score"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS x, 1000000 * count(*) FILTER (WHERE value > 20) // count(*) AS rate_ppm FROM events GROUP BY 1")
def binomial_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("x"))
    return g.withColumn("rate_ppm", F.expr("1000000 * x div n"))


@query()
def binomial_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates with their exact 95 % interval (Clopper and Pearson), in permille."""
    return clopper_pearson(binomial_rates(spark, sf_dir))


@query(
    f"""WITH {HALVES} SELECT id, 'ratchet' AS rule_id, CASE WHEN now > greatest(base * 102 // 100, base + 10) THEN 'error' WHEN now > base THEN 'warning' ELSE 'note' END AS level,
       md5(concat('base:', id)) AS member FROM m WHERE base IS NOT NULL AND now IS NOT NULL"""
)
def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as the rows of a static-analysis report: rule, level and a stable member identity."""
    p = halves(spark, sf_dir).where("base is not null and now is not null")
    ceiling = F.greatest(F.expr("base * 102 div 100"), F.col("base") + 10)
    level = F.when(F.col("now") > ceiling, "error").when(F.col("now") > F.col("base"), "warning").otherwise("note")
    return p.select("id", F.lit("ratchet").alias("rule_id"), level.alias("level"), F.md5(F.concat_ws(":", F.lit("base"), "id").cast("binary")).alias("member"))


def sarif(findings: DataFrame, path: str) -> None:
    """Write findings as SARIF result objects, one JSON object a line."""
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("level"), F.struct(F.concat(F.lit("member "), "member").alias("text")).alias("message"))
    findings.select(F.to_json(result).alias("value")).write.mode("overwrite").text(path)


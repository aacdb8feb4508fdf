"""What changes between two versions of a text, and names that texts mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import fold_key, identifier_words
from loomery.plans.registry import query
from loomery.session import settled, tasks
from loomery.sources.tables import table

VERSIONS = r"""line AS (SELECT conv_id, turn, k AS pos, trim(parts[k]) AS body FROM (
    SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\n') AS parts FROM conversations))
    WHERE regexp_matches(parts[k], '[\p{L}\p{N}]')),
side AS (SELECT conv_id, turn AS pair, 'before' AS side, pos, body FROM line UNION ALL SELECT conv_id, turn - 2, 'after', pos, body FROM line WHERE turn >= 2)"""


def version_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, pair, side, pos, body: significant lines of a turn and of the next one of the same speaker."""
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "body")).where(F.col("body").rlike(r"[\p{L}\p{N}]"))
    lines = lines.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("pos"), F.trim("body").alias("body"))
    before = lines.select("conv_id", F.col("turn").alias("pair"), F.lit("before").alias("side"), "pos", "body")
    return before.unionAll(lines.where("turn >= 2").select("conv_id", F.col("turn") - 2, F.lit("after"), "pos", "body"))


MOVED = """flag AS (SELECT *, max(CASE WHEN side = 'before' THEN 1 ELSE 0 END) OVER w AS b, max(CASE WHEN side = 'after' THEN 1 ELSE 0 END) OVER w AS a
         FROM side WINDOW w AS (PARTITION BY conv_id, pair, body)),
class AS (SELECT conv_id, pair, side, pos, body, CASE WHEN a = 1 AND b = 1 THEN 'moved' WHEN side = 'before' THEN 'deleted' ELSE 'novel' END AS class FROM flag)"""


def classes(lines: DataFrame) -> DataFrame:
    """Each line is moved if its text is on the other side too, else deleted (before) or novel (after)."""
    key = ["conv_id", "pair", "body"]
    sides = lines.groupBy(*key).agg(F.countDistinct("side").alias("sides"))
    moved = F.when(F.col("sides") == 2, "moved").when(F.col("side") == "before", "deleted").otherwise("novel")
    return lines.join(sides, key).select("conv_id", "pair", "side", "pos", "body", moved.alias("class"))


@query(f"WITH {VERSIONS}, {MOVED} SELECT conv_id, pair, side, class, count(*) AS n FROM class GROUP BY ALL")
def four_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(version_lines(spark, sf_dir)).groupBy("conv_id", "pair", "side", "class").agg(F.count("*").alias("n"))


@query(
    f"""WITH {VERSIONS}, {MOVED}, left_over AS (SELECT conv_id, pair, side, pos FROM class WHERE class <> 'moved'),
       g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY conv_id, pair, side ORDER BY pos) AS gap FROM left_over),
       r AS (SELECT *, sum(CASE WHEN gap <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, pair, side ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g)
       SELECT conv_id, pair, side, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r GROUP BY conv_id, pair, side, run"""
)
def leftover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that did not move, bridged over at most seven other lines."""
    rest = classes(version_lines(spark, sf_dir)).where("class <> 'moved'")
    by = Window.partitionBy("conv_id", "pair", "side").orderBy("pos")
    r = rest.withColumn("gap", F.col("pos") - F.lag("pos").over(by))
    r = r.withColumn("run", F.sum(F.when(F.col("gap") <= 8, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("conv_id", "pair", "side", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("run")


@query(f"WITH {VERSIONS} SELECT conv_id, pair, body, max(side) AS side FROM side GROUP BY conv_id, pair, body HAVING count(*) = 1")
def one_sided_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur once, on one side only."""
    g = version_lines(spark, sf_dir).groupBy("conv_id", "pair", "body")
    return g.agg(F.max("side").alias("side"), F.count("*").alias("n")).where("n = 1").drop("n")


def relocated(lines: DataFrame, n: int | None = None) -> DataFrame:
    """file, pair, unit, removed, added: units whose changed lines all went to other units or came from them.

    ``lines`` are (file, pair, side, unit, body), the side before or after; a line that a unit repeats
    counts once. A line is changed where its unit has it on one side only, and moved if the pair has a
    changed line of the same body on the other side. A unit must be on both sides and have a change.
    Lines are dealt over ``n`` tasks, which have to grow with them (as any shuffle has, where not told).
    """
    n = n or tasks(lines, 0)
    side = lambda name: F.max((F.col("side") == name).cast("int"))
    each = lines.repartition(n, "file", "pair", "unit", "body").groupBy("file", "pair", "unit", "body").agg(side("before").alias("b"), side("after").alias("a"))
    gone, come = (F.col("b") > F.col("a")).cast("int"), (F.col("a") > F.col("b")).cast("int")
    each = settled(each.withColumn("gone", gone).withColumn("come", come), "unit-lines")
    # One sending serves both: what is asked of a body and what it is told.
    each = each.repartition(n, "file", "pair", "body")
    moved = each.where("gone + come = 1").groupBy("file", "pair", "body").agg(F.min("gone").alias("low"), F.max("gone").alias("high")).where("low < high")
    told = each.join(moved.select("file", "pair", "body", F.lit(1).alias("moved")).hint("merge"), ["file", "pair", "body"], "left")
    stayed = F.sum((F.col("gone") + F.col("come")) * (1 - F.coalesce("moved", F.lit(0))))
    g = told.repartition(n, "file", "pair", "unit").groupBy("file", "pair", "unit").agg(F.max("b").alias("b"), F.max("a").alias("a"), F.sum("gone").alias("removed"), F.sum("come").alias("added"), stayed.alias("stayed"))
    return g.where("b = 1 and a = 1 and removed + added > 0 and stayed = 0").select("file", "pair", "unit", "removed", "added")


#: Lines of orders that a task holds.
SOLD = 250_000


@query(
    """WITH l AS (SELECT DISTINCT l_suppkey AS file, year(l_shipdate) AS y, round(100 * l_discount)::INTEGER AS unit, p_brand AS body FROM lineitem JOIN part ON p_partkey = l_partkey),
       s AS (SELECT file, y AS pair, 1 AS b, 0 AS a, unit, body FROM l UNION ALL SELECT file, y - 1, 0, 1, unit, body FROM l),
       e AS (SELECT file, pair, unit, body, max(b) AS b, max(a) AS a FROM s GROUP BY ALL),
       m AS (SELECT *, a <> b AND max(CASE WHEN b > a THEN 1 ELSE 0 END) OVER w + max(CASE WHEN a > b THEN 1 ELSE 0 END) OVER w = 2 AS moved FROM e WINDOW w AS (PARTITION BY file, pair, body))
       SELECT file AS supplier, pair::INTEGER AS year, unit, count(*) FILTER (WHERE b > a) AS removed, count(*) FILTER (WHERE a > b) AS added FROM m GROUP BY ALL
       HAVING max(b) = 1 AND max(a) = 1 AND count(*) FILTER (WHERE a <> b) > 0 AND count(*) FILTER (WHERE a <> b AND NOT moved) = 0"""
)
def relocated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts (in percent) of a supplier whose brands, from one year to the next, only changed places with other discounts."""
    unit = F.round(100 * F.col("l_discount")).cast("int")
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    sold = sold.select(F.col("l_suppkey").alias("file"), F.year("l_shipdate").alias("pair"), unit.alias("unit"), F.col("p_brand").alias("body"))
    sides = F.array(F.struct(F.col("pair").alias("pair"), F.lit("before").alias("side")), F.struct((F.col("pair") - 1).alias("pair"), F.lit("after").alias("side")))
    n = tasks(table(spark, sf_dir, "lineitem"), SOLD)
    # In what is dealt by supplier and discount a line is found once, and meets its part before that.
    found = relocated(sold.repartition(n, "file", "pair", "unit").distinct().select("file", F.inline(sides), "unit", "body"), n)
    return found.select(F.col("file").alias("supplier"), F.col("pair").alias("year"), "unit", "removed", "added")


@query(
    f"""WITH {VERSIONS}, n AS (SELECT conv_id, pair, body, count(*) FILTER (WHERE side = 'after') - count(*) FILTER (WHERE side = 'before') AS n FROM side GROUP BY ALL)
       SELECT conv_id, pair, body, n FROM n WHERE n > 0"""
)
def novel_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After-side lines less before-side lines, as a multiset."""
    sign = F.when(F.col("side") == "after", 1).otherwise(-1).cast("long")
    return version_lines(spark, sf_dir).groupBy("conv_id", "pair", "body").agg(F.sum(sign).alias("n")).where("n > 0")


NAMES = r"""tok AS (SELECT DISTINCT item_id, name FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM benchmark)),
doc AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents))"""


def mentions(df: DataFrame, key: str) -> DataFrame:
    """key, name: distinct identifiers that each text spells."""
    names = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    return df.select(key, F.explode(names).alias("name")).distinct()


@query(f"WITH {NAMES} SELECT name, count(*) AS n_files, min(doc_id) AS first_file FROM doc GROUP BY name")
def mention_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each identifier, how many documents spell it and the first of them."""
    return mentions(table(spark, sf_dir, "documents"), "doc_id").groupBy("name").agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_file"))


@query(
    rf"""WITH {NAMES}, fold AS (SELECT DISTINCT lower(translate(name, '_-$', '')) AS k FROM doc WHERE length(name) >= 7)
       SELECT item_id, name FROM tok WHERE name NOT IN (SELECT name FROM doc) AND (length(name) < 7 OR lower(translate(name, '_-$', '')) NOT IN (SELECT k FROM fold))"""
)
def unmentioned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of benchmark items that no document spells, nor, if long enough, spells alike but for case and joints."""
    tok = mentions(table(spark, sf_dir, "benchmark"), "item_id")
    doc = mentions(table(spark, sf_dir, "documents"), "doc_id").select("name").distinct()
    long = lambda d: d.where(F.length("name") >= 7).select(fold_key(F.col("name")).alias("k")).distinct()
    rest = tok.join(doc, "name", "left_anti").withColumn("k", F.when(F.length("name") >= 7, fold_key(F.col("name"))))
    return rest.join(long(doc), "k", "left_anti").select("item_id", "name")


@query(
    """WITH w AS (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || replace(p_brand, '#', ' ')), ' ') AS w FROM part)
       SELECT id, array_to_string(w, '|') AS w, len(w) AS n FROM w"""
)
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a camel-case identifier made of a part's name and brand."""
    camel = F.concat(F.initcap(F.regexp_replace("p_name", " ", "_")), F.lit("_"), F.regexp_replace("p_brand", "#", ""))
    w = identifier_words(camel)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(w, "|").alias("w"), F.size(w).cast("long").alias("n"))

"""Trees of pages: units, clones by edit distance, and what groups of equal shape have in common.

A page is the tree of its tags. Pages of equal trees form a class, named by the smallest page; only
classes are compared, so copies of a page cost nothing. Two classes are compared by edit distance
only if their sizes and their counts of tags allow the asked similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.operators.trees import near_distance, post_order
from loomery.plans.registry import query
from loomery.session import settled
from loomery.sources.tables import table

# Nodes of a unit that is judged, and the percentage of unchanged nodes of a clone.
LEAST_NODES, ALIKE = 24, 85
#: Pairs of trees whose distances one task computes, on the average.
PAIRS = 32
#: Tags that have no end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: What is in comments, scripts and styles is no markup; neither is what begins with an exclamation mark.
NOISE = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<![^>]*>"
TAG = r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>[^<]*"

_VOID_SQL = ", ".join(f"'{t}'" for t in VOID)
NODES = rf"""tag AS (SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS k
    FROM (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{NOISE}', '', 'g'), '{TAG}') AS t FROM pages)),
step AS (SELECT page_id, k, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, t LIKE '</%' AS ends,
                trim(regexp_replace(t, '^[^>]*>', '')) AS body FROM tag),
moved AS (SELECT *, CASE WHEN ends THEN -1 WHEN tag IN ({_VOID_SQL}) THEN 0 ELSE 1 END AS d FROM step),
deep AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY k) + CASE WHEN d = 0 THEN 1 ELSE 0 END AS depth FROM moved),
node AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS pos, tag, depth::INTEGER AS depth, body,
                lead(depth) OVER (PARTITION BY page_id ORDER BY k) AS next FROM deep WHERE NOT ends),
leafy AS (SELECT page_id, pos, tag, depth, body, coalesce(next, -1000000) <= depth AS leaf, min(depth) OVER (PARTITION BY page_id) AS top FROM node),
unit AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE depth = top) AS roots, any_value(top) = min(depth) FILTER (WHERE pos = 0) AS from_top,
                string_agg(tag || ' ' || (depth - top), ',' ORDER BY pos) AS form,
                string_agg(CASE WHEN leaf THEN '' ELSE tag END || ' ' || (depth - top), ',' ORDER BY pos) AS shape FROM leafy GROUP BY page_id),
judged AS (SELECT *, CASE WHEN n < {LEAST_NODES} THEN 'small' WHEN roots > 1 OR NOT from_top THEN 'forest' ELSE 'tree' END AS kind,
                  min(page_id) OVER (PARTITION BY form) AS class FROM unit)"""


def nodes(pages: DataFrame) -> DataFrame:
    """page_id, pos (from 0, in the order of the text), tag, depth, body (the text behind the tag), leaf.

    An end tag closes what was opened last; one too many makes later nodes shallower.
    """
    clean = F.regexp_replace(F.coalesce("html", F.lit("")), NOISE, "")
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(TAG), 0)).alias("at", "t"))
    tag, ends = F.lower(F.regexp_extract("t", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1)), F.col("t").startswith("</")
    t = t.select("page_id", "at", tag.alias("tag"), ends.alias("ends"), F.trim(F.regexp_replace("t", "^[^>]*>", "")).alias("body"))
    own = Window.partitionBy("page_id").orderBy("at")
    t = t.withColumn("d", F.when(F.col("ends"), -1).when(F.col("tag").isin(*VOID), 0).otherwise(1))
    t = t.withColumn("depth", (F.sum("d").over(own) + F.when(F.col("d") == 0, 1).otherwise(0)).cast("int")).where("not ends")
    leaf = F.coalesce(F.lead("depth").over(own) <= F.col("depth"), F.lit(True))
    return t.select("page_id", (F.row_number().over(own) - 1).alias("pos"), "tag", "depth", "body", leaf.alias("leaf"))


def _spelled(tag: Column, depth: Column) -> Column:
    return F.concat(tag, F.lit(" "), depth.cast("string"))


def units(node: DataFrame) -> DataFrame:
    """page_id, n, kind (tree, small, forest), class, form (a string for the tree) and shape (the same, tags of leaves left out)."""
    one = F.struct("pos", "tag", "depth", "leaf")
    g = node.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("t"), F.min("depth").alias("top"))
    low = F.size(F.filter("t", lambda x: x["depth"] == F.col("top")))
    form = F.array_join(F.transform("t", lambda x: _spelled(x["tag"], x["depth"] - F.col("top"))), ",")
    shape = F.array_join(F.transform("t", lambda x: _spelled(F.when(x["leaf"], "").otherwise(x["tag"]), x["depth"] - F.col("top"))), ",")
    single = (low == 1) & (F.col("t")[0]["depth"] == F.col("top"))
    kind = F.when(F.size("t") < LEAST_NODES, "small").when(~single, "forest").otherwise("tree")
    u = settled(g.select("page_id", F.size("t").cast("long").alias("n"), kind.alias("kind"), form.alias("form"), shape.alias("shape")), "units")
    # The join is on the page, the minimum by the form: one form of many pages meets in no task.
    first = u.groupBy("form").agg(F.min("page_id").alias("class"))
    return settled(u.join(first, "form").select("page_id", "n", "kind", "class", "form", "shape"), "units")


@query(f"WITH {NODES} SELECT page_id, n, kind, class FROM judged")
def tree_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's tree: its nodes, whether it is judged, and the smallest page of an equal tree."""
    return units(nodes(table(spark, sf_dir, "pages"))).select("page_id", "n", "kind", "class")


def judged(unit: DataFrame) -> DataFrame:
    """The first page of each class of judged trees."""
    return unit.where((F.col("kind") == "tree") & (F.col("page_id") == F.col("class")))


def candidates(unit: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, common: classes that neither bound rules out.

    A tree is the set of its tags, each numbered among its equals: the intersection of two sets is
    the sum of the smaller counts. It must hold ALIKE percent of the larger tree, so two trees meet
    under one of the rarest elements of either: only that many are posted.
    """
    c = judged(unit).select(F.col("class").alias("id"), "n", F.transform(F.split("form", ","), lambda x: F.split(x, " ")[0]).alias("tags"))
    counts = c.select("id", "n", F.explode("tags").alias("tag")).groupBy("id", "n", "tag").agg(F.count("*").cast("int").alias("of"))
    each = counts.select("id", "n", "tag", F.explode(F.sequence(F.lit(1), F.col("of"))).alias("k"))
    each = each.select("id", "n", F.concat_ws(" ", "tag", F.col("k").cast("string")).alias("e"))
    often = settled(each.groupBy("e").agg(F.count("*").alias("often")), "tree-often")
    sets = each.join(often, "e").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "e"))).alias("s"))
    sets = settled(sets.select("id", "n", F.transform("s", lambda x: x["e"]).alias("s")), "tree-sets")
    first = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * ALIKE / 100) + 1).cast("int"))
    posted = settled(sets.select("id", "n", F.explode(first).alias("e")), "tree-posted")
    a, b = (posted.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), "e") for x in "ab")
    large, small = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    met = a.join(b, "e").where((F.col("a") < F.col("b")) & (small * 100 >= large * ALIKE)).select("a", "b", "n_a", "n_b").distinct()
    x, y = (sets.select(F.col("id").alias(v), F.col("s").alias(f"s_{v}")) for v in "ab")
    both = met.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")).cast("long"))
    return both.where(F.col("common") * 100 >= large * ALIKE).select("a", "b", "n_a", "n_b", "common")


@query(
    f"""WITH {NODES}, c AS (SELECT class, n FROM judged WHERE kind = 'tree' AND page_id = class),
       h AS (SELECT page_id, tag, count(*) AS k FROM leafy GROUP BY ALL),
       p AS (SELECT a.class AS a, b.class AS b, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.class < b.class AND least(a.n, b.n) * 100 >= {ALIKE} * greatest(a.n, b.n)),
       s AS (SELECT a, b, n_a, n_b, sum(least(x.k, y.k))::BIGINT AS common FROM p JOIN h x ON x.page_id = a JOIN h y ON y.page_id = b AND y.tag = x.tag GROUP BY ALL)
       SELECT * FROM s WHERE common * 100 >= {ALIKE} * greatest(n_a, n_b)"""
)
def tree_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes that the bounds by size and by tags let pass."""
    return candidates(units(nodes(table(spark, sf_dir, "pages"))))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of the pairs that are clones; the others are left out."""

    def read(form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [p.split(" ") for p in form.split(",")]
        order, first = post_order([int(d) for _, d in parts])
        tags = np.array([t for t, _ in parts])
        return tags, tags[order], first

    for b in batches:
        trees = [(read(x), read(y)) for x, y in zip(b.column("form_a").to_pylist(), b.column("form_b").to_pylist())]
        ted = pa.array([near_distance(x, y, max(len(x[0]), len(y[0])) * (100 - ALIKE) // 100) for x, y in trees], pa.int64())
        of, found = b.filter(ted.is_valid()), ted.drop_null()
        yield pa.RecordBatch.from_arrays([*[of.column(c) for c in ("a", "b", "n_a", "n_b")], found], ["a", "b", "n_a", "n_b", "ted"])


def clones(unit: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, ted: classes of which at least ALIKE percent of the larger tree stay as they are."""
    forms = unit.where(F.col("page_id") == F.col("class"))
    a, b = (forms.select(F.col("class").alias(x), F.col("form").alias(f"form_{x}")) for x in "ab")
    found = settled(candidates(unit), "tree-candidates")
    # Pairs are small and their distances slow: without a number of tasks Spark puts them into one by their size.
    tasks = min(found.count() // PAIRS + 1, 10_000)
    pairs = found.join(a, "a").join(b, "b").repartition(tasks, "a", "b")
    return pairs.mapInArrow(_distances, "a long, b long, n_a long, n_b long, ted long")


@query()
def tree_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of pages whose trees are clones, with their edit distance."""
    return clones(units(nodes(table(spark, sf_dir, "pages"))))


def groups(unit: DataFrame) -> DataFrame:
    """page_id, group: the smallest judged page of the same shape and inner tags, where there are two or more."""
    t = unit.where("kind = 'tree'")
    g = t.groupBy("shape").agg(F.min("page_id").alias("group"), F.count("*").alias("members")).where("members > 1")
    return t.join(g, "shape").select("page_id", "group", "members")


@query(
    f"""WITH {NODES}, g AS (SELECT page_id, min(page_id) OVER (PARTITION BY shape) AS "group", count(*) OVER (PARTITION BY shape) AS members FROM judged WHERE kind = 'tree')
       SELECT * FROM g WHERE members > 1"""
)
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that differ in their leaves only."""
    return groups(units(nodes(table(spark, sf_dir, "pages"))))


def generalised(node: DataFrame, group: DataFrame) -> DataFrame:
    """group, pos, inner, fixed, value, param: the least general tree of each group, node by node.

    A node is its tag (of a leaf) and the text behind it. Where all members agree it is fixed and
    has that value; elsewhere it is a hole, and holes that are filled alike in every member (their
    tags too, unless all of a hole's are one) are one parameter, named by the first of them. Fillings are compared by two sums of hashes of member
    and value, which combine before the shuffle: no group is gathered in one place.
    """
    tag = F.when(F.col("leaf"), F.col("tag")).otherwise("")
    each = node.join(group, "page_id").select("group", "pos", (~F.col("leaf")).alias("inner"), "page_id", tag.alias("tag"), "body", F.concat(tag, F.lit(" "), F.col("body")).alias("value"))
    mark = lambda c, seed: F.sum(F.xxhash64(F.lit(seed), "page_id", c).cast("decimal(20,0)"))
    tags = F.when(F.min("tag") < F.max("tag"), mark("tag", 3)).otherwise(0)
    g = each.groupBy("group", "pos", "inner").agg(F.min("value").alias("low"), F.max("value").alias("high"), mark("body", 1).alias("h1"), mark("body", 2).alias("h2"), tags.alias("h3"))
    fixed = F.col("low") == F.col("high")
    g = settled(g.select("group", "pos", "inner", fixed.alias("fixed"), F.when(fixed, F.col("low")).alias("value"), "h1", "h2", "h3"), "merge-holes")
    first = g.where("not fixed").groupBy("group", "h1", "h2", "h3").agg(F.min("pos").alias("param"))
    holes = g.where("not fixed").join(first, ["group", "h1", "h2", "h3"])
    return holes.select("group", "pos", "inner", "fixed", "value", "param").unionByName(
        g.where("fixed").select("group", "pos", "inner", "fixed", "value", F.lit(None).cast("int").alias("param"))
    )


@query(
    f"""WITH {NODES}, g AS (SELECT page_id, min(page_id) OVER (PARTITION BY shape) AS "group", count(*) OVER (PARTITION BY shape) AS members FROM judged WHERE kind = 'tree'),
       e AS (SELECT "group", pos, NOT leaf AS inside, page_id, CASE WHEN leaf THEN tag ELSE '' END AS tag, body FROM leafy JOIN g USING (page_id) WHERE members > 1),
       t AS (SELECT "group", pos, inside, count(DISTINCT tag || ' ' || body) = 1 AS fixed, min(tag || ' ' || body) AS value,
             md5(string_agg(page_id || ':' || md5(body), ',' ORDER BY page_id)) || CASE WHEN count(DISTINCT tag) > 1 THEN string_agg(page_id || ':' || tag, ',' ORDER BY page_id) ELSE '' END AS filled FROM e GROUP BY ALL)
       SELECT "group", pos, inside AS "inner", fixed, CASE WHEN fixed THEN value END AS value,
              CASE WHEN NOT fixed THEN min(pos) OVER (PARTITION BY "group", fixed, filled) END AS param FROM t"""
)
def merge_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages of each group have in common, and the holes where they differ."""
    node = settled(nodes(table(spark, sf_dir, "pages")), "page-nodes")
    return generalised(node, groups(units(node)))

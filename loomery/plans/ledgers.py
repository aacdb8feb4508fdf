"""What changes add and what of it stands, identities that survive edits, credit for moves, one suggestion a set."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.plans.registry import query
from loomery.plans.trees import NODES, nodes, units
from loomery.session import settled
from loomery.sources.tables import table

LINES = r"""line AS (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(coalesce(text, ''), '\n'))) AS body FROM conversations),
held AS (SELECT conv_id, turn, body, count(*) AS n FROM line WHERE regexp_matches(body, '[\p{L}\p{N}]') GROUP BY ALL),
step AS (SELECT conv_id, turn, body, n AS now, 0 AS was FROM held UNION ALL SELECT conv_id, turn + 2, body, 0, n FROM held WHERE (conv_id, turn + 2) IN (SELECT (conv_id, turn) FROM conversations)),
change AS (SELECT conv_id, turn, body, greatest(sum(now) - sum(was), 0) AS added, greatest(sum(was) - sum(now), 0) AS removed FROM step GROUP BY ALL),
final AS (SELECT conv_id, turn % 2 AS speaker, max(turn) AS turn FROM conversations GROUP BY ALL)"""


def ledger(turns: DataFrame) -> DataFrame:
    """conv_id, turn, added, appended, rewrote, surviving, churned: what each version adds to the one before it.

    A speaker's turns are the versions of one text; its lines are compared as a multiset, the first
    version with an empty one. Of the added lines as many are rewritten as were removed, the others are
    appended, so an empty side before rewrites nothing. The lines of the last version are those that
    were added last; they survive, all others are churned: added = appended + rewrote = surviving + churned.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))
    held = turns.select("conv_id", "turn", F.explode(lines).alias("body")).where(F.col("body").rlike(r"[\p{L}\p{N}]")).groupBy("conv_id", "turn", "body").agg(F.count("*").alias("n"))
    held = settled(held, "version-lines")
    known = turns.select("conv_id", "turn").distinct()
    # Every version's lines stand on the near side of its own step and on the far side of the next one.
    was = held.select("conv_id", (F.col("turn") + 2).alias("turn"), "body", F.lit(0).cast("long").alias("now"), F.col("n").alias("was")).join(known, ["conv_id", "turn"], "left_semi")
    step = held.select("conv_id", "turn", "body", F.col("n").alias("now"), F.lit(0).cast("long").alias("was")).unionByName(was)
    step = step.groupBy("conv_id", "turn", "body").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    change = step.select("conv_id", "turn", "body", F.greatest(F.col("now") - F.col("was"), F.lit(0)).alias("added"), F.greatest(F.col("was") - F.col("now"), F.lit(0)).alias("removed"))
    speaker = (F.col("turn") % 2).alias("speaker")
    last = known.groupBy("conv_id", speaker).agg(F.max("turn").alias("turn"))
    stands = held.join(last, ["conv_id", "turn"]).select("conv_id", "speaker", "body", F.col("n").alias("stands"))
    change = change.withColumn("speaker", speaker).join(stands, ["conv_id", "speaker", "body"], "left").withColumn("stands", F.coalesce("stands", F.lit(0)))
    later = Window.partitionBy("conv_id", "speaker", "body").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("stands") - F.coalesce(F.sum("added").over(later), F.lit(0))
    change = change.withColumn("surviving", F.greatest(F.lit(0), F.least("added", left)))
    g = change.groupBy("conv_id", "turn").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("surviving").alias("surviving"))
    rewrote = F.least("added", "removed")
    return g.select("conv_id", "turn", "added", (F.col("added") - rewrote).alias("appended"), rewrote.alias("rewrote"), "surviving", (F.col("added") - F.col("surviving")).alias("churned"))


@query(
    f"""WITH {LINES}, o AS (SELECT c.*, coalesce(h.n, 0) AS stands FROM change c JOIN final f ON f.conv_id = c.conv_id AND f.speaker = c.turn % 2 LEFT JOIN held h ON h.conv_id = c.conv_id AND h.turn = f.turn AND h.body = c.body),
       s AS (SELECT *, greatest(0, least(added, stands - coalesce(sum(added) OVER (PARTITION BY conv_id, turn % 2, body ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS surviving FROM o),
       g AS (SELECT conv_id, turn, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, sum(surviving)::BIGINT AS surviving FROM s GROUP BY ALL)
       SELECT conv_id, turn, added, added - least(added, removed) AS appended, least(added, removed) AS rewrote, surviving, added - surviving AS churned FROM g"""
)
def churn_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each turn appends to or rewrites of the speaker's turn before, and how many of them the last one still has."""
    return ledger(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def chain_anchors(tags: list[str], depths: list[int]) -> list[str]:
    """For nodes in pre-order: the tags from the outermost element down, and the node's number among equal ones."""
    open_: list[tuple[int, str]] = []
    seen: dict[str, int] = {}
    out = []
    for tag, depth in zip(tags, depths):
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        chain = f"{open_[-1][1]}>{tag}" if open_ else tag
        open_.append((depth, chain))
        out.append(f"{chain}#{seen.get(chain, 0)}")
        seen[chain] = seen.get(chain, 0) + 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _anchors(sides: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for tags, depths in sides:
        yield pd.Series([chain_anchors(list(t), list(d)) for t, d in zip(tags, depths)])


@query(
    f"""WITH RECURSIVE {NODES},
       up AS (SELECT c.page_id, c.pos, c.tag, max(p.pos) AS parent FROM node c LEFT JOIN node p ON p.page_id = c.page_id AND p.pos < c.pos AND p.depth < c.depth GROUP BY ALL),
       chain AS (SELECT page_id, pos, tag AS chain FROM up WHERE parent IS NULL UNION ALL SELECT u.page_id, u.pos, c.chain || '>' || u.tag FROM chain c JOIN up u ON u.page_id = c.page_id AND u.parent = c.pos)
       SELECT page_id, pos, chain || '#' || (row_number() OVER (PARTITION BY page_id, chain ORDER BY pos) - 1) AS anchor FROM chain"""
)
def element_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity for every element of a page: its chain of tags and its order under it, so that what goes elsewhere moves it not."""
    g = nodes(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "depth"))).alias("t"))
    listed = g.select("page_id", _anchors(F.transform("t", lambda x: x["tag"]), F.transform("t", lambda x: x["depth"])).alias("a"))
    return listed.select("page_id", F.posexplode("a").alias("pos", "anchor"))


def credit(held: DataFrame) -> DataFrame:
    """file, step, matches, relocated, passes: runs that a file has and had not, and that were elsewhere before.

    ``held`` are distinct (file, step, run). A match is relocated if the run occurs no more often, over
    all files, than it did the step before; a file's write passes if all its matches are.
    """
    occurs = settled(held.groupBy("run", "step").agg(F.count("*").alias("n")), "occurrences")
    before = lambda d: d.withColumn("step", F.col("step") + 1)
    new = held.join(before(held), ["file", "step", "run"], "left_anti")
    met = new.join(occurs.withColumnRenamed("n", "now"), ["run", "step"]).join(before(occurs).withColumnRenamed("n", "head"), ["run", "step"])
    g = met.groupBy("file", "step").agg(F.count("*").alias("matches"), F.count_if(F.col("now") <= F.col("head")).alias("relocated"))
    return g.withColumn("passes", F.col("matches") == F.col("relocated"))


@query(
    """WITH h AS (SELECT DISTINCT l_suppkey AS supplier, year(l_shipdate) AS y, l_partkey AS part FROM lineitem),
       o AS (SELECT part, y, count(*) AS n FROM h GROUP BY ALL),
       m AS (SELECT h.supplier, h.y, a.n AS now, b.n AS head FROM h JOIN o a ON a.part = h.part AND a.y = h.y JOIN o b ON b.part = h.part AND b.y = h.y - 1
             WHERE NOT EXISTS (SELECT 1 FROM h p WHERE p.supplier = h.supplier AND p.part = h.part AND p.y = h.y - 1))
       SELECT supplier, y::INTEGER AS year, count(*) AS matches, count(*) FILTER (WHERE now <= head) AS relocated, count(*) FILTER (WHERE now <= head) = count(*) AS passes FROM m GROUP BY ALL"""
)
def relocation_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that come to a supplier in a year and were shipped by others the year before: moved if no more suppliers ship them than then."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.year("l_shipdate").alias("step"), F.col("l_partkey").alias("run")).distinct()
    return credit(settled(li, "shipped")).withColumnsRenamed({"file": "supplier", "step": "year"})


FAMILIES = ("form", "shape")


def suggestions(member: DataFrame) -> DataFrame:
    """family, first, n: each set of members once, by the first family that has it.

    ``member`` are (family, key, id), the family a number. A set is compared by its size, its least
    member and two sums of hashes of its members, which combine before the shuffle; no set is gathered.
    """
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(20,0)"))
    sets = member.groupBy("family", "key").agg(F.min("id").alias("first"), F.count("*").alias("n"), mark(1).alias("h1"), mark(2).alias("h2")).where("n > 1")
    return sets.groupBy("first", "n", "h1", "h2").agg(F.min("family").alias("family")).select("family", "first", "n")


@query(
    f"""WITH {NODES}, t AS (SELECT page_id, form, shape FROM judged WHERE kind = 'tree'),
       s AS (SELECT 0 AS family, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS members, min(page_id) AS first, count(*) AS n FROM t GROUP BY form
             UNION ALL SELECT 1, string_agg(page_id::VARCHAR, ',' ORDER BY page_id), min(page_id), count(*) FROM t GROUP BY shape)
       SELECT CASE WHEN min(family) = 0 THEN 'form' ELSE 'shape' END AS family, min(first) AS first, min(n) AS n FROM s WHERE n > 1 GROUP BY members"""
)
def merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages to merge: equal trees, and equal but for their leaves; one suggestion for one set of pages."""
    u = units(nodes(table(spark, sf_dir, "pages"))).where("kind = 'tree'")
    keys = F.array(*[F.struct(F.lit(i).alias("family"), F.sha2(c, 256).alias("key")) for i, c in enumerate(FAMILIES)])
    s = suggestions(u.select(F.inline(keys), F.col("page_id").alias("id")))
    return s.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("family") + 1))


from loomery.plans import registry as registry  # All queries are registered, in one order, whichever module is asked for first.

"""Sentences, word windows, names that go, line diffs and texts that are repeated in long runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions import shingles, turn_id, words
from loomery.plans.changes import VERSIONS, mentions, version_lines
from loomery.plans.clones import hash_pairs
from loomery.plans.registry import query
from loomery.plans.texts import TURNS, shared_pairs, turn_shingles
from loomery.sources.tables import table

# Words that prose is not known by.
STOP = (
    "a an the of to and or in on for is are be was this that it its as by with from at if not we you i s t "
    "into than then so but do does all any no our can will which when what each one"
).split()
#: Words of a verbatim run that makes two texts duplicates.
RUN = 50
#: Cells that the comparison of two texts may fill; larger ones are compared as sets, and say so.
CELLS = 4_000_000


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS w FROM documents),
       n AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE w NOT IN ({', '.join(f"'{w}'" for w in STOP)})) AS n_kept FROM w GROUP BY doc_id)
       SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_kept, 0) AS n_kept FROM documents LEFT JOIN n USING (doc_id)"""
)
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, and how many are left without stop words."""
    d = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    kept = F.filter("w", lambda w: ~w.isin(*STOP))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(kept).cast("long").alias("n_kept"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[.!?;]+(\s|\z)|[。！？；]+')) AS ended, regexp_matches(coalesce(text, ''), '[^.!?;。！？；\s]\s*\z') AS open FROM conversations)
       SELECT conv_id, turn, (ended + CASE WHEN open THEN 1 ELSE 0 END)::BIGINT AS n FROM s"""
)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences per turn: they end at a terminator before white space or the end, never inside a name."""
    text = F.coalesce("text", F.lit(""))
    n = F.regexp_count(text, F.lit(r"[.!?;]+(\s|\z)|[。！？；]+")) + F.when(text.rlike(r"[^.!?;。！？；\s]\s*\z"), 1).otherwise(0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.cast("long").alias("n"))


@query(
    r"""WITH p AS (SELECT item_id, unnest(regexp_split_to_array(coalesce(text, ''), '[()\[\]{}]')) AS part FROM benchmark),
       n AS (SELECT item_id, len(regexp_extract_all(lower(part), '[\p{L}\p{N}]+')) AS n FROM p), k AS (SELECT unnest([1, 2, 3]) AS size)
       SELECT item_id, size, sum(n - size + 1)::BIGINT AS n FROM n JOIN k ON n >= size GROUP BY ALL"""
)
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one, two and three words of each item; none goes across a bracket."""
    p = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"[()\[\]{}]")).alias("part"))
    n = p.select("item_id", F.size(words(F.col("part"))).alias("n"))
    n = n.select("item_id", "n", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("size")).where("n >= size")
    return n.groupBy("item_id", "size").agg(F.sum(F.col("n") - F.col("size") + 1).alias("n"))


@query(
    r"""WITH doc AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)
       SELECT name, len(regexp_extract_all(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]+[a-z0-9]*|[a-z0-9]+'))::BIGINT AS n FROM doc"""
)
def name_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each name that a document spells: cut at underscores and capitals, a run of capitals is one."""
    names = mentions(table(spark, sf_dir, "documents"), "doc_id").select("name").distinct()
    return names.select("name", segment_count(F.col("name")).cast("long").alias("n"))


def segment_count(name: Column) -> Column:
    """The last capital of a run begins the next segment if a small letter follows it."""
    cut = F.regexp_replace(name, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.regexp_count(cut, F.lit("[A-Z]+[a-z0-9]*|[a-z0-9]+"))


@query(
    rf"""WITH {VERSIONS}, n AS (SELECT conv_id, pair, side, unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM side),
       both_sides AS (SELECT conv_id, pair FROM side GROUP BY ALL HAVING count(DISTINCT side) = 2)
       SELECT conv_id, pair, name FROM n JOIN both_sides USING (conv_id, pair) WHERE side = 'before' EXCEPT SELECT conv_id, pair, name FROM n WHERE side = 'after'"""
)
def erased_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before a change that are nowhere after it; where one moved to another line it is not erased."""
    lines = version_lines(spark, sf_dir)
    n = lines.select("conv_id", "pair", "side", F.explode(F.regexp_extract_all("body", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    changed = lines.where("side = 'after'").select("conv_id", "pair").distinct()
    gone = n.groupBy("conv_id", "pair", "name").agg(F.max("side").alias("last"), F.min("side").alias("first")).where("first = 'before' and last = 'before'")
    # 'after' sorts first: a name with neither side 'after' has only 'before'.
    return gone.join(changed, ["conv_id", "pair"], "left_semi").select("conv_id", "pair", "name")


@query(
    f"""WITH {VERSIONS}, n AS (SELECT conv_id, pair, body, count(*) FILTER (WHERE side = 'after') AS after, count(*) FILTER (WHERE side = 'before') AS before FROM side GROUP BY ALL)
       SELECT conv_id, pair, body, before, after FROM n WHERE after >= 2 AND after > before"""
)
def duplicated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a change leaves twice or more, and more often than before."""
    side = F.col("side")
    g = version_lines(spark, sf_dir).groupBy("conv_id", "pair", "body").agg(F.count_if(side == "before").alias("before"), F.count_if(side == "after").alias("after"))
    return g.where("after >= 2 and after > before")


def common_lines(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one row of its table is held at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@F.pandas_udf(T.StructType([T.StructField("kept", T.LongType()), T.StructField("degraded", T.BooleanType())]))
def _compare(sides: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for before, after in sides:
        rows = []
        for a, b in zip(before, after):
            large = len(a) * len(b) > CELLS
            rows.append((len(set(a) & set(b)) if large else common_lines(list(a), list(b)), large))
        yield pd.DataFrame(rows, columns=["kept", "degraded"])


def line_diffs(lines: DataFrame) -> DataFrame:
    """conv_id, pair, removed, added, degraded: a smallest set of lines to take out and put in.

    ``degraded`` tells texts too long to be compared in order: lines both have count as kept.
    """
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "body")))), lambda r: r["body"]).alias(s)
    g = lines.groupBy("conv_id", "pair").agg(side("before"), side("after")).withColumn("c", _compare("before", "after"))
    left = lambda s: (F.size(s) - F.col("c.kept")).cast("long")
    return g.select("conv_id", "pair", left("before").alias("removed"), left("after").alias("added"), F.col("c.degraded").alias("degraded"))


@query()
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_diffs(version_lines(spark, sf_dir))


@query(
    rf"""WITH {TURNS}, size AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
       shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
       near AS (SELECT id_a, id_b FROM shared JOIN size x ON x.id = id_a JOIN size y ON y.id = id_b WHERE n_both * 100 >= 80 * (x.n + y.n - n_both)),
       long AS (SELECT DISTINCT id, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 48)) AS k FROM w)),
       g AS (SELECT id, s, count(*) OVER (PARTITION BY s) AS n, lead(id) OVER (PARTITION BY s ORDER BY id) AS next FROM long),
       run AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.s = b.s AND a.id < b.id WHERE a.n <= 64
               UNION SELECT id, next FROM g WHERE n > 64 AND next IS NOT NULL),
       al AS (SELECT id_a, id_b, true AS near, false AS run FROM near UNION ALL SELECT id_a, id_b, false, true FROM run)
       SELECT id_a, id_b, bool_or(near) AS near, bool_or(run) AS run FROM al GROUP BY id_a, id_b"""
)
def turn_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns with a Jaccard similarity of 0.8 or more, or with a verbatim run of 50 words.

    Two texts have such a run if they share a part of 50 words; parts of more than 64 turns are
    chained, which keeps their turns connected.
    """
    p = shared_pairs(turn_shingles(spark, sf_dir).select("id", "s").distinct(), 0.8)
    near = p.where(F.col("n_both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("n_both")) * 80).select("id_a", "id_b", F.lit(True).alias("near"), F.lit(False).alias("run"))
    c = table(spark, sf_dir, "conversations").select(turn_id().alias("id"), words(F.col("text")).alias("w"))
    part = F.transform(shingles(F.col("w"), RUN), lambda s: F.md5(s.cast("binary")))
    long = c.select("id", F.explode(F.array_distinct(part)).alias("h")).withColumn("k", F.lit(0))
    run = hash_pairs(long).select("id_a", "id_b").distinct().select("id_a", "id_b", F.lit(False), F.lit(True))
    return near.unionAll(run).groupBy("id_a", "id_b").agg(F.bool_or("near").alias("near"), F.bool_or("run").alias("run"))

"""Segments, shingles and near-duplicate texts of conversations and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import line_count, shingles, turn_id, words
from loomery.plans.registry import query
from loomery.session import settled
from loomery.sources.tables import table

#: Words that a segment needs to be judged, and words of a shingle.
FLOOR, WIDTH = 50, 5

SEGMENTS = r"""seg AS (
    SELECT doc_id, k - 1 AS seg, trim(parts[k], chr(10)) AS body
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n') AS parts FROM documents))
    WHERE trim(parts[k], ' ') <> ''
)"""


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg, body: the paragraphs of each text; here a line is one, blank ones are none."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seg", "body"))
    return parts.where(F.trim("body") != "")


@query(
    f"""WITH {SEGMENTS}, w AS (SELECT doc_id, seg, len(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS n FROM seg)
       SELECT doc_id, count(*) AS n_segments, count(*) FILTER (WHERE n >= 50) AS n_judged, count(*) FILTER (WHERE n < 50) AS below_floor,
              max(n)::INTEGER AS longest FROM w GROUP BY doc_id"""
)
def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments per document, and how many reach the floor of 50 words."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("n", F.size(words(F.col("body"))))
    judged = F.col("n") >= FLOOR
    return s.groupBy("doc_id").agg(
        F.count("*").alias("n_segments"), F.count_if(judged).alias("n_judged"), F.count_if(~judged).alias("below_floor"), F.max("n").alias("longest")
    )


@query(
    """SELECT doc_id, lang, CASE WHEN coalesce(text, '') = '' THEN 0
              ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS lines
       FROM documents"""
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", line_count(F.col("text")).cast("long").alias("lines"))


TURNS = r"""w AS (SELECT conv_id::BIGINT * 1048576 + turn AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM conversations),
sh AS (SELECT id, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS k FROM w)),
sets AS (SELECT DISTINCT id, s FROM sh)"""


def turn_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, s: the five-word shingles of each turn by position."""
    c = table(spark, sf_dir, "conversations")
    c = c.select(turn_id().alias("id"), words(F.col("text")).alias("w"))
    return c.select("id", F.posexplode(shingles(F.col("w"), WIDTH)).alias("k", "s"))


def shared_pairs(sets: DataFrame, least: float) -> DataFrame:
    """id_a, id_b, n_both of sets (id, s) that share an element, for pairs that may reach Jaccard ``least``.

    Elements are taken rarest first, and a pair of that similarity meets in the first part of both
    sets; the other part, where frequent elements are, is never joined.
    """
    sets = settled(sets, "sets")
    # Merged, not broadcast: such tables grow with the texts, and each broadcast is held by the driver.
    often = sets.groupBy("s").agg(F.count("*").alias("f")).hint("merge")
    own = Window.partitionBy("id")
    ranked = sets.join(often, "s").withColumn("n", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("f", "s")))
    front = settled(ranked.where((F.col("f") > 1) & (F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1)).select("id", "n", "s"), "fronts")
    other = front.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "s").hint("merge")
    close = (F.col("n") >= F.col("n_b") * least) & (F.col("n_b") >= F.col("n") * least)
    pairs = front.join(other, "s").where((F.col("id") < F.col("id_b")) & close).select(F.col("id").alias("id_a"), "id_b", F.col("n").alias("n_a"), "n_b").distinct()
    x = sets.select(F.col("id").alias("id_a"), "s").join(pairs.hint("merge"), "id_a")
    y = sets.select(F.col("id").alias("id_b"), "s").hint("merge")
    return x.join(y, ["id_b", "s"]).groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("n_both"))


@query(
    f"""WITH {TURNS}, size AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
       shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
       SELECT id_a, id_b, n_both, x.n + y.n - n_both AS n_union FROM shared JOIN size x ON x.id = id_a JOIN size y ON y.id = id_b
       WHERE n_both * 100 >= 80 * (x.n + y.n - n_both)"""
)
def turn_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    p = shared_pairs(turn_shingles(spark, sf_dir).select("id", "s").distinct(), 0.8)
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return p.where(F.col("n_both") * 100 >= union * 80).select("id_a", "id_b", "n_both", union.alias("n_union"))


ITEMS = r"""bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
b AS (SELECT item_id, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM bw)),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
d AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM dw))"""


@query(
    f"""WITH {ITEMS}, hit AS (SELECT doc_id, item_id, d.k - b.k AS diagonal, d.k FROM d JOIN b USING (s)),
       island AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS run FROM (SELECT DISTINCT * FROM hit)),
       runs AS (SELECT doc_id, item_id, count(*) + 4 AS n FROM island GROUP BY doc_id, item_id, diagonal, run)
       SELECT doc_id, item_id, max(n) AS longest_run FROM runs GROUP BY ALL HAVING max(n) >= 10"""
)
def verbatim_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of words that a document has in common with a benchmark item, of 10 words or more.

    Shingles that meet at one distance of positions (a diagonal) and follow each other are a run.
    The benchmark's side is the small one; Spark broadcasts it when its measured size allows.
    """
    of = lambda name, key: table(spark, sf_dir, name).select(key, words(F.col("text")).alias("w"))
    b = of("benchmark", "item_id").select("item_id", F.posexplode(shingles(F.col("w"), WIDTH)).alias("kb", "s"))
    d = of("documents", "doc_id").select("doc_id", F.posexplode(shingles(F.col("w"), WIDTH)).alias("k", "s"))
    hit = d.join(b, "s").select("doc_id", "item_id", (F.col("k") - F.col("kb")).alias("diagonal"), "k")
    by = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("k")
    runs = hit.withColumn("run", F.col("k") - F.row_number().over(by)).groupBy("doc_id", "item_id", "diagonal", "run").agg((F.count("*") + WIDTH - 1).alias("n"))
    return runs.groupBy("doc_id", "item_id").agg(F.max("n").alias("longest_run")).where("longest_run >= 10")


@query(
    r"""SELECT doc_id, regexp_matches(array_to_string(regexp_split_to_array(coalesce(text, ''), '\n')[1:5], chr(10)), '(?i)licen[cs]ed? under|all rights reserved') AS at_head,
              regexp_matches(coalesce(text, ''), '(?i)licen[cs]ed? under|all rights reserved') AS anywhere FROM documents"""
)
def licence_exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a licence marker, and whether it stands in the first five lines."""
    marker = "(?i)licen[cs]ed? under|all rights reserved"
    text = F.coalesce("text", F.lit(""))
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", head.rlike(marker).alias("at_head"), text.rlike(marker).alias("anywhere"))

"""Repeats inside a stream, floors and occurrences of runs, kinds, MinHash signatures and bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomery.functions import fnv, shingles, turn_id, words
from loomery.operators.coverage import coverage
from loomery.plans.clones import CLONES, GRAMS, KGRAM, kgrams, runs, turn_tasks, winnow
from loomery.plans.registry import query
from loomery.plans.texts import turn_shingles
from loomery.sources.tables import table

#: Distinct tokens that a run must hold.
DISTINCT = 7

DOC_GRAMS = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
gram AS (SELECT id, k - 1 AS k, array_to_string(w[k:k + 4], ' ') AS h FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS k FROM w))"""


@query(
    f"""WITH {DOC_GRAMS}, again AS (SELECT id, k, lead(k) OVER (PARTITION BY id, h ORDER BY k) - k AS gap FROM gram),
       run AS (SELECT id, gap, min(k) AS start, least(count(*) + 4, gap) AS n FROM (
           SELECT *, k - row_number() OVER (PARTITION BY id, gap ORDER BY k) AS i FROM again WHERE gap IS NOT NULL) GROUP BY id, gap, i),
       best AS (SELECT *, row_number() OVER (PARTITION BY id, gap ORDER BY n DESC, start) AS r FROM run WHERE n >= 5)
       SELECT id AS doc_id, gap, start, n FROM best WHERE r = 1"""
)
def self_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that a document repeats ``gap`` words on: the longest of each distance.

    A run is no longer than its distance, so that it does not overlap its own repeat. Each part is
    compared with its next occurrence only; the pairs stay as many as the words.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words(F.col("text")).alias("w"))
    g = d.select("id", F.posexplode(shingles(F.col("w"), KGRAM)).alias("k", "h"))
    again = g.withColumn("gap", F.lead("k").over(Window.partitionBy("id", "h").orderBy("k")) - F.col("k")).where("gap is not null").drop("h")
    i = F.col("k") - F.row_number().over(Window.partitionBy("id", "gap").orderBy("k"))
    n = F.least(F.count("*") + KGRAM - 1, F.col("gap"))
    run = again.withColumn("i", i).groupBy("id", "gap", "i").agg(F.min("k").alias("start"), n.alias("n")).where(F.col("n") >= KGRAM)
    best = F.max_by(F.struct("start", "n"), F.struct("n", -F.col("start")))
    out = run.groupBy(F.col("id").alias("doc_id"), F.col("gap").cast("long").alias("gap")).agg(best.alias("b"))
    return out.select("doc_id", "gap", F.col("b.start").cast("long").alias("start"), F.col("b.n").cast("long").alias("n"))


@query(
    f"""WITH {GRAMS}, {CLONES}, t AS (SELECT id, w AS tokens FROM w)
       SELECT id_a, id_b, start_a, start_a + diagonal AS start_b, n, len(list_distinct(tokens[start_a + 1:start_a + n])) AS n_distinct,
              len(list_distinct(tokens[start_a + 1:start_a + n])) >= 7 AS judged FROM run JOIN t ON t.id = id_a"""
)
def run_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone runs with their distinct tokens; those of fewer than seven are not judged."""
    c = table(spark, sf_dir, "conversations").select(turn_id().alias("id_a"), words(F.col("text")).alias("w"))
    part = F.slice("w", (F.col("start_a") + 1).cast("int"), F.col("n").cast("int"))
    r = runs(kgrams(spark, sf_dir), n=turn_tasks(spark, sf_dir)).join(c, "id_a").withColumn("n_distinct", F.size(F.array_distinct(part)).cast("long")).drop("w")
    return r.withColumn("judged", F.col("n_distinct") >= DISTINCT).select("id_a", "id_b", "start_a", "start_b", "n", "n_distinct", "judged")


@query(f"WITH {GRAMS} SELECT h, count(*) AS n_starts, count(DISTINCT id) AS n_streams FROM gram WHERE h IN (SELECT h FROM fp) GROUP BY h")
def fingerprint_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At how many positions each fingerprint starts, overlapping ones too, and in how many turns."""
    g = kgrams(spark, sf_dir)
    of = g.join(winnow(g).select("h").distinct(), "h", "left_semi").groupBy("h", "id").agg(F.count("*").alias("n"))
    return of.groupBy("h").agg(F.sum("n").alias("n_starts"), F.count("*").alias("n_streams"))


KINDS = r"""w AS (SELECT conv_id::BIGINT * 1048576 + turn AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM conversations),
kind AS (SELECT id, k, CASE WHEN length(w[k]) <= 3 THEN 's' WHEN length(w[k]) <= 6 THEN 'm' ELSE 'l' END AS kind FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM w))"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind: the kinds of a turn's words in order: short, middle or long."""
    c = table(spark, sf_dir, "conversations").select(turn_id().alias("id"), words(F.col("text")).alias("w"))
    of = F.transform("w", lambda w: F.when(F.length(w) <= 3, "s").when(F.length(w) <= 6, "m").otherwise("l"))
    return c.select("id", of.alias("kind"))


@query(
    f"""WITH {KINDS}, s AS (SELECT id, k - 1 AS k, kind || ' ' || lead(kind, 1) OVER o || ' ' || lead(kind, 2) OVER o AS shingle FROM kind WINDOW o AS (PARTITION BY id ORDER BY k))
       SELECT id, shingle, min(k) AS first FROM s WHERE shingle IS NOT NULL GROUP BY ALL"""
)
def kind_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct runs of three kinds of each turn, with where each comes first."""
    s = kinds(spark, sf_dir).select("id", shingles(F.col("kind"), 3).alias("all"))
    s = s.select("id", "all", F.explode(F.array_distinct("all")).alias("shingle"))
    return s.select("id", "shingle", (F.array_position("all", F.col("shingle")) - 1).alias("first"))


@query(f"WITH {KINDS} SELECT id, kind, count(*) AS n FROM kind GROUP BY ALL")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(spark, sf_dir).select("id", F.explode("kind").alias("kind")).groupBy("id", "kind").agg(F.count("*").alias("n"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _signatures(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in sets:
        yield pd.Series([fnv.signature(x).view(np.int64) for x in s])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(signatures: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in signatures:
        yield pd.Series(list(fnv.band_keys(np.stack(s.to_numpy()).astype(np.int64).view(np.uint64)).view(np.int64)) if len(s) else [])


def signed(sets: DataFrame) -> DataFrame:
    """id, signature: 128 MinHash values (unsigned, stored as long) of the set of ``s`` of each id."""
    return sets.groupBy("id").agg(F.collect_set(F.xxhash64("s")).alias("set")).select("id", _signatures("set").alias("signature"))


@query()
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(turn_shingles(spark, sf_dir).select("id", "s"))


def banded(signatures: DataFrame) -> DataFrame:
    """id, band, key: the key of every band of each signature."""
    return signatures.select("id", F.posexplode(_keys("signature")).alias("band", "key"))


def buckets(signatures: DataFrame) -> DataFrame:
    """band, key, n, first: bands of four values that two or more ids have alike, and the least of them."""
    return banded(signatures).groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


@query()
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets(minhash_signatures(spark, sf_dir))


#: Tokens of a run that is judged, and of those how many no longer run of the pair may have.
JUDGED, OWN = 8, 6


@query()
def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone runs by whether they are reported, suppressed by longer ones of their pair, or dropped as too short."""
    return coverage(runs(kgrams(spark, sf_dir), n=turn_tasks(spark, sf_dir)), JUDGED, OWN)

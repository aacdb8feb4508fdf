"""Where pairs of page trees come from, and what the bounds say of each pair.

Streams are the tags of a tree in the order of the text; only classes of equal trees are paired.
Each source groups classes under a key and pairs the members of a group: all of a small group,
neighbours (in the order of ids) of one above HOT, which keeps a hot group together by as many
pairs as it has members. A class is under a key once, however often it has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import shingles
from loomery.plans.clones import GRAMS, HOT, grams_of, hash_pairs, wide_grams, winnow
from loomery.plans.overlaps import banded, signed
from loomery.plans.registry import query
from loomery.plans.trees import ALIKE, NODES, candidates, judged, nodes, units
from loomery.session import settled
from loomery.sources.tables import table

#: Tags of a run that two trees must share to be near, and of a structural shingle.
RUN, SHINGLE = 12, 3
#: Bits of the sources of a pair, in this order.
SOURCES = ("run", "name", "fingerprint", "bands", "bounds")
#: Last part of an address's path, without its ending, its query and its fragment.
NAME = r"^[a-z]+://[^/?#]+(?:/[^/?#]*)*?/([^/?#.]+)[^/?#]*/?(?:[?#].*)?$"

_STREAMS = "w AS (SELECT class AS id, list_transform(string_split(form, ','), lambda x: split_part(x, ' ', 1)) AS w FROM judged WHERE kind = 'tree' AND page_id = class)"
_GRAMS = f"{NODES}, {_STREAMS}, {GRAMS[GRAMS.index('gram AS') :]}"


def _pairs_sql(keyed: str) -> str:
    return f"""keyed AS ({keyed}), met AS (SELECT h, id, count(*) OVER (PARTITION BY h) AS n, lead(id) OVER (PARTITION BY h ORDER BY id) AS id2 FROM keyed)
       SELECT x.id AS a, y.id AS b FROM met x JOIN met y ON x.h = y.h AND x.id < y.id WHERE x.n <= {HOT} UNION SELECT id, id2 FROM met WHERE n > {HOT} AND id2 IS NOT NULL"""


def _paired(keyed: DataFrame) -> DataFrame:
    """a, b: distinct pairs of ids under a common key h."""
    once = settled(keyed.select("id", "h").distinct().withColumn("k", F.lit(0)), "tree-keys")
    return hash_pairs(once).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(nodes(table(spark, sf_dir, "pages")))


def streams(unit: DataFrame) -> DataFrame:
    """id, w: the tags of each judged class."""
    tags = F.transform(F.split("form", ","), lambda x: F.split(x, " ")[0])
    return judged(unit).select(F.col("class").alias("id"), tags.alias("w"))


def structure(unit: DataFrame) -> DataFrame:
    """id, s: distinct runs of SHINGLE tags of each judged class."""
    return streams(unit).select("id", F.explode(shingles(F.col("w"), SHINGLE)).alias("s")).distinct()


@query(
    f"""WITH {NODES}, {_STREAMS}, t AS (SELECT id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS k FROM w)
       SELECT id, array_to_string(w[k:k + {SHINGLE - 1}], ' ') AS s, min(k - 1) AS first, count(*) AS n FROM t GROUP BY ALL"""
)
def tag_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three tags of each judged tree: where each comes first, and how often."""
    t = streams(page_units(spark, sf_dir)).select("id", F.posexplode(shingles(F.col("w"), SHINGLE)).alias("k", "s"))
    return t.groupBy("id", "s").agg(F.min("k").cast("long").alias("first"), F.count("*").alias("n"))


@query(f"WITH {NODES}, {_STREAMS} SELECT id, tag, count(*) AS n FROM (SELECT id, unnest(w) AS tag FROM w) GROUP BY ALL")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each judged tree has each tag."""
    t = streams(page_units(spark, sf_dir)).select("id", F.explode("w").alias("tag"))
    return t.groupBy("id", "tag").agg(F.count("*").alias("n"))


def run_pairs(unit: DataFrame) -> DataFrame:
    """Trees that share a run of RUN tags."""
    return _paired(wide_grams(grams_of(streams(unit)), RUN))


@query(
    f"""WITH {NODES}, {_STREAMS}, t AS (SELECT id, w, unnest(range(1, len(w) - {RUN - 2})) AS k FROM w),
       {_pairs_sql(f"SELECT DISTINCT id, array_to_string(w[k:k + {RUN - 1}], ' ') AS h FROM t")}"""
)
def tree_run_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_pairs(page_units(spark, sf_dir))


def name_pairs(unit: DataFrame, pages: DataFrame) -> DataFrame:
    """Trees of which two pages have one name; pages without a name have no partner by it."""
    name = F.regexp_extract(F.coalesce("url", F.lit("")), NAME, 1)
    named = pages.select("page_id", name.alias("h")).where("h <> ''")
    return _paired(unit.where("kind = 'tree'").join(named, "page_id").select(F.col("class").alias("id"), "h"))


@query(
    f"""WITH {NODES}, named AS (SELECT page_id, regexp_extract(coalesce(url, ''), '{NAME}', 1) AS h FROM pages),
       {_pairs_sql("SELECT DISTINCT class AS id, h FROM judged JOIN named USING (page_id) WHERE kind = 'tree' AND h <> ''")}"""
)
def tree_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(page_units(spark, sf_dir), table(spark, sf_dir, "pages"))


def fingerprint_pairs(unit: DataFrame) -> DataFrame:
    """Trees that share a winnowed fingerprint of their tags."""
    return _paired(winnow(grams_of(streams(unit))))


@query(f"WITH {_GRAMS}, {_pairs_sql('SELECT DISTINCT id, h FROM fp')}")
def tree_fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(page_units(spark, sf_dir))


def band_pairs(unit: DataFrame) -> DataFrame:
    """Trees whose MinHash signatures of structural shingles agree in a band."""
    key = F.concat_ws(" ", F.col("band").cast("string"), F.col("key").cast("string"))
    return _paired(banded(signed(structure(unit))).select("id", key.alias("h")))


@query()
def tree_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_pairs(page_units(spark, sf_dir))


def sourced(unit: DataFrame, pages: DataFrame) -> DataFrame:
    """a, b, sources, n_a, n_b, common, verdict of every pair that any source has.

    ``sources`` has bit i for SOURCES[i]. ``common`` is the number of tags that can stay, each tag as
    often as the tree has it that has it less often. The verdict is ``size`` where the larger tree is
    too large for the smaller, ``labels`` where too few tags are common, else ``judged``.
    """
    found = [run_pairs(unit), name_pairs(unit, pages), fingerprint_pairs(unit), band_pairs(unit), candidates(unit).select("a", "b")]
    every = None
    for i, pairs in enumerate(found):
        pairs = pairs.select("a", "b", F.lit(1 << i).alias("bit"))
        every = pairs if every is None else every.unionByName(pairs)
    every = settled(every.groupBy("a", "b").agg(F.bit_or("bit").alias("sources")), "tree-pairs")
    tags = streams(unit).select("id", F.size("w").cast("long").alias("n"), F.explode("w").alias("tag")).groupBy("id", "n", "tag").agg(F.count("*").alias("of"))
    bags = settled(tags.groupBy("id", "n").agg(F.map_from_entries(F.collect_list(F.struct("tag", "of"))).alias("bag")), "tree-bags")
    x, y = (bags.select(F.col("id").alias(v), F.col("n").alias(f"n_{v}"), F.col("bag").alias(f"bag_{v}")) for v in "ab")
    # A bag has an entry for each different tag, and HTML has few.
    least = lambda acc, t: acc + F.least(F.col("bag_a")[t], F.coalesce(F.col("bag_b")[t], F.lit(0)))
    common = F.aggregate(F.map_keys("bag_a"), F.lit(0).cast("long"), least)
    both = every.join(x, "a").join(y, "b").select("a", "b", "sources", "n_a", "n_b", common.alias("common"))
    large, small = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    verdict = F.when(small * 100 < large * ALIKE, "size").when(F.col("common") * 100 < large * ALIKE, "labels").otherwise("judged")
    return both.withColumn("verdict", verdict)


@query()
def tree_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of page trees with the sources that name them and the verdict of the bounds."""
    pages = table(spark, sf_dir, "pages")
    return sourced(units(nodes(pages)), pages)

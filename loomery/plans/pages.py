"""Links between pages: extraction, path joining, resolution with named refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.plans.registry import query
from loomery.sources.tables import table


def joined_path(base_dir: Column, spec: Column) -> Column:
    """``spec`` seen from ``base_dir`` with ``.`` and ``..`` worked off; null where it climbs above the root.

    An absolute spec starts over from the root.
    """
    whole = F.when(spec.startswith("/"), spec).otherwise(F.concat(base_dir, F.lit("/"), spec))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))

    def step(acc, part):
        up, here = part == "..", (part == "") | (part == ".")
        path, deep = acc["path"], F.size(acc["path"]) > 0
        shorter = F.when(deep, F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path)
        new = F.when(here, path).when(up, shorter).otherwise(F.concat(path, F.array(part)))
        return F.struct(new.alias("path"), (acc["ok"] & (~up | deep)).alias("ok"))

    done = F.aggregate(F.split(whole, "/"), start, step)
    return F.when(done["ok"], F.concat(F.lit("/"), F.array_join(done["path"], "/")))


def targets(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every page, without query and fragment."""
    url = F.regexp_replace("url", "[?#].*$", "")
    host, path = F.regexp_extract(url, "^[a-z]+://([^/]*)", 1), F.regexp_replace(url, "^[a-z]+://[^/]*", "")
    return pages.select("page_id", host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, href: every link of a page, once."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), 1)
    return pages.select("page_id", F.explode(found).alias("href")).distinct()


PAGES = """page AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://([^/]*)', 1) AS host,
                CASE WHEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') = '' THEN '/'
                     ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') END AS path FROM pages),
link AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"WITH {PAGES} SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE href LIKE '/%') AS n_absolute FROM link GROUP BY page_id")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = links(table(spark, sf_dir, "pages")).groupBy("page_id")
    return g.agg(F.count("*").alias("n_links"), F.count_if(F.col("href").startswith("/")).alias("n_absolute"))


@query(
    f"""WITH {PAGES}, spec AS (SELECT page_id, path, href FROM (SELECT page_id, '/' || split_part(href, '/', 2) AS head, href FROM link WHERE href LIKE '/%') JOIN page USING (page_id)),
       known AS (SELECT string_split(path, '/')[2] AS section, count(DISTINCT page_id) AS n, min(page_id) AS first FROM page GROUP BY 1)
       SELECT page_id, href, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'hit' END AS answer, CASE WHEN n = 1 THEN first END AS target
       FROM spec LEFT JOIN known ON known.section = split_part(href, '/', 2)"""
)
def page_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each absolute link's first directory names: one page is a hit, several are a refusal, none is unknown."""
    pages = table(spark, sf_dir, "pages")
    known = targets(pages).select("page_id", F.element_at(F.split("path", "/"), 2).alias("section"))
    known = known.groupBy("section").agg(F.countDistinct("page_id").alias("n"), F.min("page_id").alias("first"))
    spec = links(pages).where(F.col("href").startswith("/")).withColumn("section", F.split_part("href", F.lit("/"), F.lit(2)))
    n = F.col("n")
    answer = F.when(n.isNull(), "unknown").when(n > 1, "ambiguous").otherwise("hit")
    return spec.join(known, "section", "left").select("page_id", "href", answer.alias("answer"), F.when(n == 1, F.col("first")).alias("target"))


@query(
    f"""WITH {PAGES}, d AS (SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS dir, path FROM page)
       SELECT page_id, CASE WHEN len(string_split(dir, '/')) < 2 THEN NULL ELSE regexp_replace(dir, '/[^/]*$', '') || '/x' END AS up_one,
              dir || '/x' AS here, CASE WHEN len(string_split(dir, '/')) < 4 THEN NULL ELSE regexp_replace(dir, '(/[^/]*){{3}}$', '') || '/x' END AS up_three FROM d"""
)
def path_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative specs seen from each page's directory; null above the root."""
    p = targets(table(spark, sf_dir, "pages")).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    at = lambda spec: joined_path(F.col("dir"), F.lit(spec))
    return p.select("page_id", at("../x").alias("up_one"), at("./x").alias("here"), at("../../../x").alias("up_three"))


@query(f"WITH {PAGES} SELECT host, count(*) AS n_pages, count(DISTINCT path) AS n_paths, min(page_id) AS first FROM page GROUP BY host")
def host_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = targets(table(spark, sf_dir, "pages")).groupBy("host")
    return g.agg(F.count("*").alias("n_pages"), F.countDistinct("path").alias("n_paths"), F.min("page_id").alias("first"))

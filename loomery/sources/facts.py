"""The fact tables that analyses of a source tree read, carried by the star schema.

A part is a file: its brand, type and the words of its name are directories. Every line item but
the last of its order refers from its part to the part of the order's next line; the line number
is the reference's rung and gives its kind. An order is a commit that touches the parts of its lines.
``FACTS_SQL`` states the same tables for a SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import tasks
from loomery.sources.tables import table

#: Lines of orders that a task holds; about as many references are made of them.
LINES = 500_000
#: Kinds of references that keep nothing alive.
INERT = ("asset", "refdef")

FACTS_SQL = """
file AS (
    SELECT p_partkey AS id,
           lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '/') || '-' || p_partkey || '.src' AS path,
           p_size AS lines, CASE WHEN p_size = 1 THEN 'entry' WHEN p_size >= 45 THEN 'test' ELSE 'plain' END AS role
    FROM part
),
in_dir AS (SELECT id, regexp_replace(path, '/[^/]*$', '') AS dir FROM file),
ref AS (
    SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst,
           CASE WHEN a.l_linenumber >= 6 THEN 'import' WHEN a.l_linenumber = 5 THEN 'doc_link' WHEN a.l_linenumber % 2 = 0 THEN 'asset' ELSE 'refdef' END AS kind,
           a.l_linenumber AS rung
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
),
live AS (SELECT DISTINCT src, dst FROM ref WHERE kind NOT IN ('asset', 'refdef'))
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, lines, role."""
    p = table(spark, sf_dir, "part")
    brand, name = F.lower(F.regexp_replace("p_brand", "#", "")), F.regexp_replace("p_name", " ", "/")
    path = F.concat(brand, F.lit("/"), F.lower("p_type"), F.lit("/"), name, F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".src"))
    role = F.when(F.col("p_size") == 1, "entry").when(F.col("p_size") >= 45, "test").otherwise("plain")
    return p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_size").alias("lines"), role.alias("role"))


def in_dir(file: DataFrame) -> DataFrame:
    """id, dir: the directory that holds each file."""
    return file.select("id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))


def ref_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that references are dealt over: what one joins, sorts or hashes does not grow with the lines."""
    return tasks(table(spark, sf_dir, "lineitem"), LINES)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, rung: distinct references, dealt by both files over ``ref_tasks``."""
    li, n = table(spark, sf_dir, "lineitem"), ref_tasks(spark, sf_dir)
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("next"), F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("rung"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("next"), F.col("l_partkey").alias("dst"))
    kind = F.when(F.col("rung") >= 6, "import").when(F.col("rung") == 5, "doc_link").when(F.col("rung") % 2 == 0, "asset").otherwise("refdef")
    # Lines grow with the table and are never broadcast; the rung says the kind, so that it need not be sent or compared.
    both = a.repartition(n, "l_orderkey", "next").join(b.repartition(n, "l_orderkey", "next").hint("merge"), ["l_orderkey", "next"])
    return both.select("src", "dst", "rung").repartition(n, "src", "dst").distinct().select("src", "dst", kind.alias("kind"), "rung")


def live_refs(ref: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the kinds that keep a file alive."""
    return ref.where(~F.col("kind").isin(*INERT)).select("src", "dst").distinct()

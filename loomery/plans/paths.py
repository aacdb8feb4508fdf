"""What the path of a file says: patterns, classes, entries and ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.globs import glob_regex
from loomery.plans.registry import query
from loomery.sources.facts import files

GLOBS = ("brand1/", "brand2?/**/ring-*.src", "*-[0-9].src", "{ring,bolt}-*.src")
#: Classes in the order of their declaration: patterns and the ceiling of lines, null for the general one.
CLASSES = (("core", ("brand1/", "brand2/"), 10), ("parts", ("{ring,bolt}-*.src",), None), ("first", ("*-[0-9].src",), 40))
CEILING = 30
#: Rules that make a file an entry: kind, what it compares with, name of the convention.
ENTRIES = (("basename", "widget-1.src", "widget"), ("under", "brand2/economy", "economy"), ("exact", "brand4/small/blue/bolt-2.src", "bolt"))


def matches(path: Column, globs: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*[path.rlike(glob_regex(g)) for g in globs]), True)


def owner_class(path: Column) -> Column:
    """The first declared class with a pattern that matches; null without any."""
    return F.coalesce(*[F.when(matches(path, globs), F.lit(name)) for name, globs, _ in CLASSES])


@query(
    r"""SELECT id, 'brand1/' AS glob FROM file WHERE regexp_matches(path, '^brand1/')
       UNION ALL SELECT id, 'brand2?/**/ring-*.src' FROM file WHERE regexp_matches(path, '^brand2[^/]/(.*/)?ring-[^/]*\.src$')
       UNION ALL SELECT id, '*-[0-9].src' FROM file WHERE regexp_matches(path, '-[0-9]\.src$')
       UNION ALL SELECT id, '{ring,bolt}-*.src' FROM file WHERE regexp_matches(path, '(^|/)(ring|bolt)-[^/]*\.src$')""",
    facts=True,
)
def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with each pattern that its path matches."""
    hit = F.filter(F.array(*[F.when(F.col("path").rlike(glob_regex(g)), F.lit(g)) for g in GLOBS]), lambda g: g.isNotNull())
    return files(spark, sf_dir).select("id", F.explode(hit).alias("glob"))


CLASS_SQL = r"""class AS (SELECT id, lines, CASE WHEN regexp_matches(path, '^brand[12]/') THEN 'core' WHEN regexp_matches(path, '(^|/)(ring|bolt)-[^/]*\.src$') THEN 'parts'
         WHEN regexp_matches(path, '-[0-9]\.src$') THEN 'first' END AS class FROM file)"""


@query(f"WITH {CLASS_SQL} SELECT id, class FROM class", facts=True)
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that owns each file, null where none does."""
    return files(spark, sf_dir).select("id", owner_class(F.col("path")).alias("class"))


@query(
    f"""WITH {CLASS_SQL}, c AS (SELECT *, CASE class WHEN 'core' THEN 10 WHEN 'first' THEN 40 ELSE 30 END AS ceiling FROM class)
       SELECT id, class, ceiling, lines > ceiling AS over FROM c""",
    facts=True,
)
def class_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against the ceiling of the owning class, or the general one where it has none."""
    f = files(spark, sf_dir).select("id", "lines", owner_class(F.col("path")).alias("class"))
    own = F.coalesce(*[F.when(F.col("class") == name, F.lit(n)) for name, _, n in CLASSES], F.lit(CEILING))
    return f.select("id", "class", own.alias("ceiling"), (F.col("lines") > own).alias("over"))


@query(
    """SELECT id, 'widget' AS convention FROM file WHERE regexp_extract(path, '([^/]*)$', 1) = 'widget-1.src'
       UNION SELECT id, 'economy' FROM file WHERE starts_with(path, 'brand2/economy/') UNION SELECT id, 'bolt' FROM file WHERE path = 'brand4/small/blue/bolt-2.src'""",
    facts=True,
)
def entry_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a convention makes an entry: by base name, by a directory above, or by the whole path."""
    path = F.col("path")
    test = {"basename": lambda v: F.substring_index(path, "/", -1) == v, "under": lambda v: path.startswith(v + "/"), "exact": lambda v: path == v}
    hit = F.filter(F.array(*[F.when(test[kind](value), F.lit(name)) for kind, value, name in ENTRIES]), lambda c: c.isNotNull())
    return files(spark, sf_dir).select("id", F.explode(F.array_distinct(hit)).alias("convention"))

"""Exact deduplication by progressive refinement.

Texts are equal when they are identical after every run of ASCII white space has become one
space. A first pass keeps two numbers per row, the length and the hash of a prefix of that
text, and aggregates them: a (length, prefix hash) group of one row cannot hold a copy, and a
group of two rows implies a length group of two, so both refinement steps share one shuffle.
Only rows of surviving groups have their full content hashed and grouped. Everything is
DataFrame expressions; the aggregations combine on the map side, so a group of copies that
holds a third of all rows arrives as one row per task, and the join that hands the result back
to its rows is one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import SPACE, maybe_broadcast, store, whole_text

#: Characters of the normalised text that the cheap hash covers. It orders the work only: rows
#: that agree on it are compared by a digest of their whole text.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(whole_text(text), SPACE, " ")


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """Every row of ``docs`` with the group of equal texts it belongs to.

    Returns ``carry`` (name to expression; by default the id) and ``keep_id`` (the smallest id of
    the group), ``group_size`` (long) and ``kept``. Null texts equal empty ones. A null id sorts
    after all others; a group whose ids are all null has keep_id null. Exactly one row of a group
    is kept, also where rows repeat with their id. An empty table gives no rows. Columns of
    ``docs`` other than the two named are touched only through ``carry``.
    """
    carry = {id_col: F.col(id_col)} if carry is None else carry
    text = normalised(F.col(text_col))
    length, prefix = F.length(text), F.xxhash64(F.substring(text, 1, prefix_chars))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        F.struct(*[c.alias(n) for n, c in carry.items()]).alias("__carry"),
        length.alias("__length"),
        prefix.alias("__prefix"),
    )
    cheap = ["__length", "__prefix"]
    alive = store(rows.groupBy(*cheap).count().where("count > 1").select(*cheap), "exact-alive")
    alive = maybe_broadcast(alive)
    alone = rows.join(alive, cheap, "left_anti").select(
        "__carry.*", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    full = cheap + ["__full"]
    met = store(
        rows.join(alive, cheap, "left_semi").select(
            "__id", "__carry", *cheap, text_digest(F.col("__text")).alias("__full"), F.monotonically_increasing_id().alias("__row")
        ),
        "exact-met",
    )
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    # Stored, so that both sides of the join come from a shuffle that adaptive execution may split.
    groups = store(met.groupBy(*full).agg(first.alias("__first"), F.count("*").alias("group_size")), "exact-groups")
    joined = met.join(groups, full).select(
        "__carry.*", F.col("__first.id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__first.row")).alias("kept")
    )
    return alone.unionByName(joined)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose text an earlier id has; same columns."""
    inner = {f"__c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    kept = exact_duplicates(docs, id_col, text_col, inner).where("kept")
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.session import release, scratch_path, shared_dir
from loomery.session import settled as store

__all__ = ["map_arrow", "maybe_broadcast", "n_words", "release", "scratch_path", "shared_dir", "store", "whole_text", "worker_path"]

#: ASCII white space, as every contract of this package spells it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only if it is measured to hold at most so many bytes: its texts, and so
#: many for any other value or row.
BROADCAST_BYTES, VALUE_BYTES, ROW_BYTES = 8 << 20, 8, 16
#: Bytes of one Arrow batch on its way to a Python worker: rows hold whole texts, so a number of
#: rows bounds nothing. A longer row forms a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def worker_path(spark: SparkSession) -> None:
    """Put this package's folder on the path of Python workers.

    That serves sessions whose workers share the driver's file system; elsewhere the package comes
    with the job (``--py-files``) or is installed.
    """
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, env.get("PYTHONPATH")]))


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` by workers that know this package, in batches of a few megabytes.

    A session that bounds its batches tighter keeps its own bound.
    """
    spark = df.sparkSession
    worker_path(spark)
    held = spark.conf.get(BATCH_CONF).lower().rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast if ``df`` is measured to be small; else leave the join to Spark.

    The measure is an aggregation of its own, so ``df`` should be a stored table.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in df.schema.fields):
        return df
    width = ROW_BYTES + VALUE_BYTES * len(df.columns)
    size = F.count("*") * width + sum((F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0))
    return F.broadcast(df) if df.agg(size.alias("size")).head()["size"] <= BROADCAST_BYTES else df


def whole_text(text: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of ASCII-white-space separated words; null and empty have none."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")

"""One place that turns (session, directory, name) into a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; any path that Spark reads will do."""
    if name not in TABLES:
        raise KeyError(f"no such table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

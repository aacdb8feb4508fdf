"""The event table as a feed of operations on an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.plans.registry import query
from loomery.session import scratch_path
from loomery.sources.tables import table
from loomery.streaming import current, follow, latest

OPS = """ops AS (SELECT user_id AS key, event_id AS "at", CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value FROM events),
newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC) AS r FROM ops)"""
SCHEMA = "key long, at long, op string, value double"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), op.alias("op"), "value")


@query(f"""WITH {OPS} SELECT key, "at", value FROM newest WHERE r = 1 AND op = 'upsert'""")
def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds after all operations, in one batch."""
    return latest(operations(spark, sf_dir))


@query(f"""WITH {OPS} SELECT key, "at", value FROM newest WHERE r = 1 AND op = 'upsert'""")
def stream_index_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by a stream that takes the feed file by file."""
    import uuid

    home = scratch_path(spark, "feed")
    operations(spark, sf_dir).repartitionByRange(4, "at").write.parquet(f"{home}/in")
    follow(spark, f"{home}/in", SCHEMA, f"{home}/state", f"{home}/log")
    return current(spark, f"{home}/state")

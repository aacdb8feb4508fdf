"""An index kept by upserts and deletes, fed by a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(feed: DataFrame) -> DataFrame:
    """key, at, value of the newest operation on each key; keys whose newest one is a delete are gone.

    ``feed`` has key, at, op (upsert or delete) and value; of operations at one time the delete
    comes last. The maximum combines before the shuffle, so a busy key is one row per task.
    """
    best = F.max(F.struct("at", (F.col("op") == "delete").alias("gone"), "value")).alias("m")
    return feed.groupBy("key").agg(best).where("not m.gone").select("key", "m.at", "m.value")


def folded(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state with a batch of operations: what ``latest`` says of both, deletes kept as marks.

    Marks stay in the state, or an operation that arrives late could bring a deleted key back.
    """
    by = Window.partitionBy("key").orderBy(F.desc("at"), (F.col("op") == "delete").desc(), F.desc("value"))
    both = state.unionByName(batch.select(*state.columns))
    return both.withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Read new Parquet files of ``source`` until there are no more, and keep the state below ``target``.

    Each micro-batch writes a new version named by its id; a batch that is run again after a
    failure overwrites its own version, so every operation counts once.
    """
    empty = spark.createDataFrame([], schema)

    def step(batch: DataFrame, number: int) -> None:
        before = empty if number == 0 else spark.read.schema(empty.schema).parquet(f"{target}/v={number - 1}")
        folded(before, batch).write.mode("overwrite").parquet(f"{target}/v={number}")

    feed = spark.readStream.schema(empty.schema).option("maxFilesPerTrigger", 1).parquet(source)
    feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The live keys of the newest version below ``target``."""
    versions = spark.read.parquet(target)
    newest = versions.agg(F.max("v").alias("v")).head()["v"]
    return latest(versions.where(F.col("v") == newest))

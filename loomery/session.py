"""Where loops and operators keep the tables between their steps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Codec of the stored steps. The default one keeps direct buffers of the size of its largest pages,
#: which pages of long arrays and whole texts make large, outside the heap until the heap is cleaned.
CODEC = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A session of this machine alone (tests, a laptop) may leave it unset and uses a folder of the
    machine; on a cluster that is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"loomery-{os.getuid()}")
        os.makedirs(base, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/loomery/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Files outlive any executor, values that depend on the order of rows are fixed for every later
    reader, and a plan that reads them starts from their true size: a checkpointed plan keeps the
    estimate of what made it, which joins multiply from round to round until the driver does little
    but multiply them.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, rows: int) -> int:
    """Tasks for ``df`` at some ``rows`` each, at least those of any shuffle; 0 rows: no more than those.

    What a task sorts or hashes must not grow with the table. Counted on a table as it is read, this
    reads the footers of its files alone.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, df.count() // rows + 1) if rows else least


class Rounds:
    """A table that grows by what each round of a loop finds; earlier rounds are not written again."""

    def __init__(self, spark: SparkSession, what: str = "rounds"):
        self.spark, self.path, self.n, self.schema = spark, scratch_path(spark, what), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write the round, and give back its rows."""
        path, self.n = f"{self.path}/round-{self.n}", self.n + 1
        df.write.option("compression", CODEC).parquet(path)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round-*")


def release(spark: SparkSession) -> None:
    """Delete everything that this application has stored in the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomery/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

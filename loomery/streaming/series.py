"""A series that grows by batches: one row per step, stamped with the measure that made it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the newest window that a judgment may ask for.
WINDOW = 4096


class Series:
    """Rows (step, value, stamp) below a path, in one folder for every batch.

    A step is measured once under each stamp. A batch writes only what its stamp lacks, into a
    folder that its name fixes and that is overwritten: a batch that failed half way, or is run
    twice, leaves the same rows as one that ran once. Rows of other stamps stay and are not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _stored(self) -> DataFrame | None:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return None
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").withColumn("batch", F.col("batch").cast("string"))

    def append(self, batch: str, rows: DataFrame, stamp: str) -> None:
        """Add the steps of ``rows`` (step, value) that no other batch has under this stamp."""
        new, held = rows.select("step", "value").dropDuplicates(["step"]).withColumn("stamp", F.lit(stamp)), self._stored()
        if held is not None:
            others = held.where((F.col("stamp") == stamp) & (F.col("batch") != batch)).select("step")
            new = new.join(others, "step", "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self, stamp: str) -> DataFrame:
        """step, value under this stamp."""
        held = self._stored()
        if held is None:
            return self.spark.createDataFrame([], "step long, value double")
        return held.where(F.col("stamp") == stamp).select("step", "value")

    def pending(self, steps: DataFrame, stamp: str) -> int:
        """How many of ``steps`` (step) have no row under this stamp."""
        return steps.select("step").distinct().join(self.rows(stamp), "step", "left_anti").count()

    def window(self, stamp: str, size: int = WINDOW) -> DataFrame:
        """The newest ``size`` rows; asking for more than WINDOW is an error."""
        if not 0 < size <= WINDOW:
            raise ValueError(f"a window has 1 to {WINDOW} rows")
        return self.rows(stamp).orderBy(F.desc("step")).limit(size)

"""History of commits (orders) and the files they touch (parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators.mates import twins
from loomery.plans.registry import query
from loomery.session import scratch_path, settled, tasks
from loomery.sources.facts import refs
from loomery.sources.tables import table
from loomery.streaming.series import Series


#: Lines of orders that a task holds, and that give some five pairs of files each.
LINES = 250_000


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, file: distinct, dealt by commit over tasks that are counted by the lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).repartition(tasks(li, LINES), "commit").distinct()


TOUCH = "touch AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS file FROM lineitem)"


def cochanged(touch: DataFrame, n: int, floor: int = 2) -> DataFrame:
    """a, b, n: files changed in the same commit at least ``floor`` times, counted in ``n`` tasks. A commit's files are few."""
    x, y = touch.select("commit", F.col("file").alias("a")), touch.select("commit", F.col("file").alias("b"))
    # Most pairs are met once: to count them before they are sent would only hold them twice.
    return x.join(y.hint("merge"), "commit").where("a < b").select("a", "b").repartition(n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= floor)


@query(f"WITH {TOUCH} SELECT x.file AS a, y.file AS b, count(*) AS n FROM touch x JOIN touch y ON x.commit = y.commit AND x.file < y.file GROUP BY ALL HAVING count(*) >= 2")
def cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochanged(touches(spark, sf_dir), tasks(table(spark, sf_dir, "lineitem"), LINES))


@query("SELECT l_partkey AS file, epoch(max(o_orderdate))::BIGINT AS newest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def newest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest commit of every file, in epoch seconds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("at"))
    return touches(spark, sf_dir).join(o, "commit").groupBy("file").agg(F.max("at").alias("newest"))


@query(
    """WITH blamed AS (SELECT l_orderkey AS commit, l_partkey AS file, sum(l_quantity) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
       added AS (SELECT l_orderkey AS commit, l_partkey AS file, sum(l_quantity) - sum(l_linenumber) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
       SELECT commit, sum(least(coalesce(b.n, 0), coalesce(a.n, 0)))::DOUBLE AS surviving,
              sum(coalesce(b.n, 0) - least(coalesce(b.n, 0), coalesce(a.n, 0)))::DOUBLE AS beyond_ledger
       FROM blamed b FULL JOIN added a USING (commit, file) GROUP BY commit"""
)
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each commit that still stand, as far as the ledger of added lines vouches for them."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), "l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")
    blamed = li.where("l_returnflag <> 'R'").groupBy("commit", "file").agg(F.sum("l_quantity").alias("b"))
    added = li.where("l_linestatus = 'F'").groupBy("commit", "file").agg((F.sum("l_quantity") - F.sum("l_linenumber")).alias("a"))
    both = blamed.join(added, ["commit", "file"], "full")
    b, a = F.coalesce("b", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return both.groupBy("commit").agg(F.sum(F.least(b, a)).alias("surviving"), F.sum(b - F.least(b, a)).alias("beyond_ledger"))


@query(
    f"""WITH {TOUCH},
       sim AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_partkey < y.p_partkey),
       gra AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ref WHERE src <> dst),
       chu AS (SELECT x.file AS a, y.file AS b, count(*) AS n FROM touch x JOIN touch y ON x.commit = y.commit AND x.file < y.file GROUP BY ALL HAVING count(*) >= 2)
       SELECT a, b, sim.a IS NOT NULL AS alike, gra.a IS NOT NULL AS linked, chu.n AS together,
              (sim.a IS NOT NULL)::INT + (gra.a IS NOT NULL)::INT + (chu.n IS NOT NULL)::INT AS confidence,
              CASE WHEN sim.a IS NOT NULL AND chu.n IS NOT NULL THEN 'merge_candidate' END AS verdict
       FROM sim FULL JOIN gra USING (a, b) FULL JOIN chu USING (a, b)""",
    facts=True,
)
def three_signal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files that are alike, linked or changed together, with what each signal says."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    r = refs(spark, sf_dir).where("src <> dst")
    linked = r.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(True).alias("linked"), F.lit(None).cast("long").alias("together"))
    together = cochange(spark, sf_dir).select("a", "b", F.lit(None).cast("boolean").alias("linked"), F.col("n").alias("together"))
    said = linked.unionByName(together).repartition(tasks(table(spark, sf_dir, "lineitem"), LINES), "a", "b")
    said = said.groupBy("a", "b").agg(F.struct(F.max("linked").alias("linked"), F.max("together").alias("together")).alias("said"))
    out = twins(p, said, ["p_name", "p_brand", "p_type"]).select("a", "b", "alike", F.coalesce("said.linked", F.lit(False)).alias("linked"), "said.together")
    changed = F.col("together").isNotNull()
    confidence = F.col("alike").cast("int") + F.col("linked").cast("int") + changed.cast("int")
    return out.withColumn("confidence", confidence).withColumn("verdict", F.when(F.col("alike") & changed, "merge_candidate"))


TREND = """day AS (SELECT o_orderpriority AS axis, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) // 30 AS t, sum(round(o_totalprice))::BIGINT AS y FROM orders GROUP BY ALL)"""


@query(
    f"""WITH {TREND} SELECT x.axis, count(*) AS n_pairs, quantile_cont((y.y - x.y)::DOUBLE / (y.t - x.t), 0.5) AS slope
       FROM day x JOIN day y ON x.axis = y.axis AND x.t < y.t GROUP BY x.axis"""
)
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theil-Sen slope per series: the median over pairs of points. A series has one point a month."""
    t = F.expr("cast(date_diff(cast(o_orderdate as date), date'1990-01-01') div 30 as bigint)")
    day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("axis"), t.alias("t")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("y"))
    other = day.select("axis", F.col("t").alias("u"), F.col("y").alias("z"))
    slope = (F.col("z") - F.col("y")).cast("double") / (F.col("u") - F.col("t"))
    return day.join(other, "axis").where("t < u").groupBy("axis").agg(F.count("*").alias("n_pairs"), F.expr("percentile(cast(z - y as double) / (u - t), 0.5)").alias("slope"))


@query(
    """SELECT user_id, session::BIGINT AS session, min(event_id) AS first_event, count(*) AS n_events FROM (
           SELECT *, sum(CASE WHEN gap <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
               SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events))
       GROUP BY user_id, session"""
)
def leftover_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a key's events whose gaps stay within half an hour: the bridge rule of leftover runs over time."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(by)).withColumn("gap", F.expr("timestampdiff(MICROSECOND, before, ts)"))
    e = e.withColumn("session", F.sum(F.when(F.col("gap") <= 1_800_000_000, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n_events"))


#: Batches in which the series of days is stored, and its stamp.
BATCHES, STAMP = 3, "v2"


@query(
    """SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS step, count(*)::DOUBLE AS value FROM orders GROUP BY 1"""
)
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each day, measured once by an older measure and then in batches that overlap by the newest one."""
    days = table(spark, sf_dir, "orders").groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("step"))
    days = settled(days.agg(F.count("*").cast("double").alias("value")), "days")
    series = Series(spark, scratch_path(spark, "series"))
    series.append("first", days.withColumn("value", F.lit(0.0)), "v1")
    part = F.pmod(F.xxhash64("step"), F.lit(BATCHES))
    for k in range(BATCHES):
        series.append(str(k), days.where(part <= k), STAMP)
    return series.rows(STAMP)

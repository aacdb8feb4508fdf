"""Mixing sources to target weights by entropy balancing.

Each source has a token budget. Among all document rates in [0, 3] that spend the budgets, the
ones closest to "every document once" in relative entropy are exponentials of the document's
size, ``rate = min(3, exp(lambda_source * size / scale_source))``; the lambdas are the dual
variables of the budgets and solve a convex problem in which sources separate. Newton's method
finds them with distributed passes over the histogram of (source, size), kept inside a bracket
so that the bend at three copies cannot mislead it. Rates become whole copies by cumulative
rounding along the sizes of a source, and one last pass moves single copies so that the words
taken meet the budget. Only built-in expressions are used.

The histogram has at most as many rows per source as there are different document sizes, and
every other table one row per source; rows of documents are never gathered by source or size
without a salt, and rows of one id are split by their number where there are many. All sums are
of decimals or integers, so no result depends on the order in which tasks end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.common import maybe_broadcast, n_words, store

MOST_COPIES = 3
MAX_STEPS = 80
TOLERANCE = 1e-9
#: Rows of one (source, size) cell that share a ranking task; cells are salted to come to that.
ROWS_PER_SALT, MAX_SALTS = 400, 1 << 16
#: Rates in fixed point: whole copies are counted in units of 2**-RATE_BITS.
RATE_BITS = 32
#: Size classes per octave from which the last correction takes its candidates.
CLASSES = 12


def source_targets(totals: DataFrame) -> DataFrame:
    """skey, source, source_size, n -> the same with ``target``.

    Sources in the order of their code points, null last, weigh 1, 2, 3, 1, 2, ... Targets share
    the total by weight but stop at three times a source's size; what lies above is shared again
    by weight. Where that ends is the level at which the capped sizes, taken in the order of cap
    over weight, and the level times the other weights make up the total. One row per source.
    """
    w = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * MOST_COPIES)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    w = w.withColumn("caps", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    w = w.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.col("caps")) / F.col("rest").cast("double"))
    w = w.withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("caps", "level"))).over(whole)["level"])
    capped = F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return w.select("skey", "source", "source_size", "n", "weight", target.alias("target"))


def _rate(lam: Column, size: Column, scale: Column) -> Column:
    x = lam * size / scale
    return F.when(x >= F.lit(math.log(MOST_COPIES)), F.lit(float(MOST_COPIES))).otherwise(F.exp(F.least(x, F.lit(2.0))))


def solve_rates(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with ``lam`` and ``scale``: Newton's method on the dual, one aggregation a step."""
    s = F.col("source_size")
    state = sources.withColumn("scale", F.greatest(s / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0)))
    ratio = F.when(s > 0, F.col("target") / s).otherwise(F.lit(1.0))
    # At these ends every rate is past the ratio, whatever the sizes: a size is 1 at least.
    end = F.col("scale") * F.when(ratio >= 1, F.lit(math.log(MOST_COPIES))).otherwise(F.ln(F.greatest(ratio, F.lit(1e-300))))
    state = store(
        state.select(
            "*",
            F.least(end, F.lit(0.0)).alias("low"),
            F.greatest(end, F.lit(0.0)).alias("high"),
            F.when(ratio >= MOST_COPIES, end).otherwise(F.lit(0.0)).alias("lam"),
            (s == 0).alias("done"),
        ),
        "mix-state",
    )
    names = state.columns
    for _ in range(MAX_STEPS):
        rows = cells.where("size > 0").join(maybe_broadcast(state), "skey")
        r = _rate(F.col("lam"), F.col("size"), F.col("scale"))
        words = (F.col("cell_n") * F.col("size")).cast("decimal(20,0)")
        # The slope only proposes a step, and the bracket judges it: a bound on its terms costs nothing.
        steep = F.least(F.col("size") / F.col("scale"), F.lit(1e6)) * r
        step = rows.groupBy("skey").agg(
            F.sum(words * r.cast("decimal(13,12)")).cast("double").alias("g"),
            F.sum(F.when(r < MOST_COPIES, words * steep.cast("decimal(16,8)"))).cast("double").alias("slope"),
        )
        new = state.join(maybe_broadcast(store(step, "mix-step")), "skey", "left")
        new = new.withColumn("gap", F.coalesce(F.col("g"), F.lit(0.0)) - F.col("target"))
        new = new.withColumn("done", F.col("done") | (F.abs("gap") <= F.lit(TOLERANCE) * F.greatest("target", F.lit(1.0))))
        new = new.withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low")))
        new = new.withColumn("high", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        move = F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise(middle)
        new = new.withColumn("done", F.col("done") | (F.col("high") - F.col("low") <= F.lit(1e-14) * F.col("scale")))
        state = store(new.withColumn("lam", move).select(*names), "mix-state")
        if state.where("not done").isEmpty():
            return state
    raise RuntimeError(f"the rates did not settle in {MAX_STEPS} steps")


def _cumulative(cells: DataFrame) -> DataFrame:
    """Copies per (source, size): base for every document, and how many get one more."""
    r = _rate(F.col("lam"), F.col("size"), F.col("scale"))
    cells = cells.withColumn("rate", F.when(F.col("size") > 0, r).otherwise(F.lit(1.0)))
    upto = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    unit = 1 << RATE_BITS
    due = F.floor(F.col("rate") * unit).cast("decimal(12,0)") * F.col("cell_n").cast("decimal(16,0)")
    cells = cells.withColumn("due", due).withColumn("sum", F.sum("due").over(upto).cast("decimal(38,0)"))
    whole = F.expr(f"(sum + {unit // 2}) div {unit} - (sum - due + {unit // 2}) div {unit}")
    return cells.withColumn("copies", F.least(F.greatest(whole, F.lit(0)), F.col("cell_n") * MOST_COPIES).cast("long")).drop("due", "sum")


def _corrected(cells: DataFrame) -> DataFrame:
    """Move single copies in a few cells of each source so that the words taken meet the target.

    Candidates are one cell of each size class, the one with most documents (then the smallest
    size); they are visited from the largest down, and each gives or takes as many copies as the
    open gap and its documents allow. Their number is bounded by the classes, not by the data.
    """
    gap = F.round(F.max("target") - F.sum(F.col("copies") * F.col("size"))).cast("long")
    gaps = cells.groupBy("skey").agg(gap.alias("gap"))
    some = cells.where("size > 0").withColumn("class", F.floor(F.log2("size") * CLASSES))
    best = F.max_by(F.struct("size", "copies", "cell_n"), F.struct("cell_n", -F.col("size")))
    some = some.groupBy("skey", "class").agg(best.alias("c")).groupBy("skey").agg(F.reverse(F.array_sort(F.collect_list("c"))).alias("cs"))

    def visit(acc, c):
        left = acc["left"]
        wish = F.floor((F.abs(left) + F.floor(c["size"] / 2)) / c["size"]).cast("long")
        wish = F.when(left > 0, F.least(wish, c["cell_n"] * MOST_COPIES - c["copies"])).otherwise(-F.least(wish, c["copies"]))
        wish = wish.cast("long")
        return F.struct(
            (left - wish * c["size"]).cast("long").alias("left"),
            F.concat(acc["moves"], F.array(F.struct(c["size"].cast("long").alias("size"), wish.alias("move")))).alias("moves"),
        )

    none = F.expr("cast(array() as array<struct<size: bigint, move: bigint>>)")
    start = F.struct(F.col("gap").alias("left"), none.alias("moves"))
    moves = gaps.join(some, "skey").select("skey", F.explode(F.aggregate("cs", start, visit, lambda a: a["moves"])).alias("m"))
    moves = moves.where("m.move <> 0").select("skey", "m.size", "m.move")
    return cells.join(moves, ["skey", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move")


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, rate, copies and taken of every row.

    ``size`` counts ASCII-white-space separated words; null and empty texts have none, keep one
    copy and take no words. Null is a source of its own. No row has more than three copies. Rows
    that repeat are rated like any others. The copies depend on the set of rows alone, so reruns
    agree. An empty table gives no rows. Other columns are ignored.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return _copies(numbered, "__row", id_col, text_col, source_col).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _copies(docs: DataFrame, row_col: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (a number of each row's own), id, source, size, source_size, target, rate and copies of every row."""
    skey = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    size = n_words(F.col(text_col)).alias("size")
    rows = store(docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), skey.alias("skey"), size), "mix-rows")
    plain = store(rows.groupBy("skey", "size").agg(F.first("source").alias("source"), F.count("*").alias("cell_n")), "mix-cells")
    totals = plain.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("cell_n")).alias("source_size"), F.sum("cell_n").alias("n"))
    state = solve_rates(plain, source_targets(totals))
    known = state.select("skey", "source_size", "target", "lam", "scale")
    cells = _corrected(_cumulative(plain.drop("source").join(maybe_broadcast(known), "skey")))
    cells = store(cells.select("skey", "size", "cell_n", "source_size", "target", "rate", "copies"), "mix-copies")

    # A cell's copies go to its rows by rank; the ranks are counted run by run. A run is a salt of
    # the cell by a hash of the id. An id with very many rows has runs of its own, by row number:
    # its rows may take their ranks in any order.
    salts = min(MAX_SALTS, max(1, rows.count() // ROWS_PER_SALT))
    hot = rows.groupBy("skey", "size", "id").agg(F.count("*").alias("of")).where(F.col("of") > ROWS_PER_SALT)
    hot = store(hot.select("skey", "size", F.col("id").alias("hot_id"), F.ceil(F.col("of") / ROWS_PER_SALT).cast("long").alias("runs")), "mix-hot")
    place = (rows["skey"] == hot["skey"]) & (rows["size"] == hot["size"]) & rows["id"].eqNullSafe(hot["hot_id"])
    salted = rows.join(maybe_broadcast(hot), place, "left").select(
        rows["*"],
        F.pmod(F.xxhash64("id", rows["skey"], rows["size"]), F.lit(salts)).cast("int").alias("salt"),
        F.when(F.col("runs").isNotNull(), F.struct(rows["id"].alias("id"), F.pmod(F.xxhash64("row"), F.col("runs")).alias("run"))).alias("own"),
    )
    run = ["skey", "size", "salt", "own"]
    runs = salted.groupBy(*run).agg(F.count("*").alias("run_n"))
    before = F.sum("run_n").over(Window.partitionBy("skey", "size").orderBy("salt", "own")) - F.col("run_n")
    runs = store(runs.withColumn("before", before).join(cells, ["skey", "size"]), "mix-runs")
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy(*run).orderBy("id")))
    same = (ranked["skey"] == runs["skey"]) & (ranked["size"] == runs["size"]) & (ranked["salt"] == runs["salt"]) & ranked["own"].eqNullSafe(runs["own"])
    out = ranked.join(runs, same).select(ranked["row"], ranked["id"], ranked["source"], ranked["size"], "source_size", "target", "rate", "copies", "cell_n", "before", "k")
    # Ranks that get one more copy lie evenly over the cell, not at its front.
    extra, rank = F.expr("cast(copies % cell_n as decimal(19,0))"), F.col("before") + F.col("k")
    out = out.withColumn("extra", extra).withColumn("rank", rank)
    more = F.expr("(rank * extra) div cell_n - ((rank - 1) * extra) div cell_n")
    copies = (F.expr("copies div cell_n") + F.least(more, F.lit(1))).cast("long")
    return out.withColumn("copies", copies).drop("cell_n", "before", "k", "extra", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; same columns.

    Rows that share an id, or have none, are taken one by one, so the mix meets its targets with
    them too. Null and empty texts stay once. An empty table stays empty.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = [f"c{names.index(c)}" for c in (id_col, text_col, source_col)]
    # Numbered once and for all, so that numbers name the same rows in both readings.
    inner = store(inner.withColumn("row", F.monotonically_increasing_id()), "mix-input")
    times = _copies(inner, "row", *at).select("row", F.col("copies").cast("int").alias("times")).where("times > 0")
    repeated = inner.join(times, "row").withColumn("copy", F.explode(F.expr("sequence(1, times)")))
    return repeated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

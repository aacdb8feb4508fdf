"""How filters of a corpus overlap, in every order, from one aggregation.

A text fails some of five filters; which ones is a mask of five bits. For each part and label the
documents are summed 32 times, with the sign of the parity of the mask under each subset of the
bits. These sums are the Walsh-Hadamard transform of the numbers of documents per mask; the inverse
transform, divided by 32, gives those numbers back exactly. Everything asked about any order of the
filters follows from 32 numbers per part: what a step removes are the masks that hold its filter
and none before it, and over all orders a document that fails ``k`` filters is removed by each of
them in ``120 / k`` (its Shapley share, in orders).

Whether a text fails the first four depends on the text alone. The fifth, being identical to the
text of a smaller id, asks for the smallest id of each text (by digest); rows are then held against
these by id and digest together, so copies of one text, however many, meet in no single task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import SPACE, store, whole_text

# The filters, in the order of their bits, and the bounds of the first three.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, r"[#$%&*|]"
MASKS = 1 << len(FILTERS)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text_mask(text: Column, words: Column) -> Column:
    n = F.size(words)
    fails = (
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(LEAST_DISTINCT),
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) * F.lit(100).cast("long") > F.length(text) * F.lit(MOST_CAPITALS),
        text.rlike(SIGNS),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _odd(mask: Column, subset: int) -> Column:
    """1 if ``mask`` has an odd number of the bits of ``subset``, else 0."""
    return F.bit_count(mask.bitwiseAND(F.lit(subset))).cast("int").bitwiseAND(F.lit(1))


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, good, toxic, mask of every row of ``docs``; see :func:`filter_audit` for odd rows."""
    text = whole_text(F.col(text_col))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = split.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = split.select("doc_id", "part", _text_mask(F.col("text"), F.col("words")).alias("own"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    rows = store(rows, "audit-rows")
    first = store(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "audit-first")
    told = labels.groupBy(F.col(id_col).cast("long").alias("told_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    own, least = rows.alias("r"), first.select(F.col("digest").alias("of"), "first_id")
    met = own.join(least, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    met = met.select("doc_id", "part", (F.col("own") + F.when(F.col("of").isNull(), 16).otherwise(0)).alias("mask"))
    met = met.join(store(told, "audit-labels"), F.col("doc_id") == F.col("told_id"), "left")
    return met.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "mask")


def mask_cells(masks: DataFrame) -> DataFrame:
    """part, docs, good, toxic: arrays of the numbers of all, good and toxic documents per mask, from 32 signed sums."""
    sums = [F.sum(F.lit(1).cast("long") - F.lit(2) * _odd(F.col("mask"), s)).alias(f"w{s}") for s in range(MASKS)]
    parity = masks.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(MASKS)]).alias("w"))

    # Row m of the transform's matrix: the sign of mask m under each subset.
    matrix = F.expr("array(" + ", ".join("array(" + ", ".join(str(1 - 2 * ((m & x).bit_count() & 1)) for x in range(MASKS)) + ")" for m in range(MASKS)) + ")")
    inverse = F.transform(matrix, lambda row: F.shiftright(F.aggregate(F.zip_with("w", row, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b), len(FILTERS)))
    cells = parity.select("part", "good", "toxic", F.posexplode(inverse).alias("mask", "n"))
    kept = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    each = cells.groupBy("part", "mask").agg(F.sum("n").alias("docs"), kept("good").alias("good"), kept("toxic").alias("toxic"))
    row = F.array_sort(F.collect_list(F.struct("mask", "docs", "good", "toxic")))
    return each.groupBy("part").agg(row.alias("c")).select("part", *[F.col(f"c.{x}").alias(x) for x in ("docs", "good", "toxic")])


def evaluate_orders(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each, from the numbers per mask."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), i + 1, 1 << f, before))
            before |= 1 << f
    spark = cells.sparkSession
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, bit int, before int"))  # 600 rows

    def total(name: str, when) -> Column:
        # Places of the array are masks.
        return F.aggregate(F.transform(name, lambda n, m: F.when(when(m), n).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)

    bit, before = F.col("bit"), F.col("before")
    has = lambda m, b: m.bitwiseAND(b) != 0
    removed = lambda m: has(m, bit) & ~has(m, before)
    share = F.array(*[F.lit(0 if m == 0 else 120 // m.bit_count()) for m in range(MASKS)])
    shapley = F.aggregate(
        F.transform(F.zip_with("docs", share, lambda n, s: n * s), lambda n, m: F.when(has(m, bit), n).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b
    )
    return cells.crossJoin(steps).select(
        "part", "filter_order", "step",
        total("docs", lambda m: ~has(m, before.bitwiseOR(bit))).alias("kept"),
        total("docs", removed).alias("removed"),
        total("docs", lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        F.element_at("docs", bit + 1).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Every part, order of the five filters and step: what the step keeps, removes and costs.

    Null texts count as empty (no words: only A fails, and E for a later one), null parts as ''.
    Equal texts: all but those of the smallest id fail E; rows that repeat the smallest id do not;
    a null id is larger than any other, and rows of null ids alone do not fail E. Labels that
    repeat count if any of them says 1; rows without a label count as neither. An empty table has
    no parts and gives no rows. Other columns are ignored.
    """
    return evaluate_orders(mask_cells(failure_masks(docs, labels, id_col, text_col, part_col)))

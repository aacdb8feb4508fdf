"""Which of overlapping runs say something of their own."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id_a", "id_b", "start_a", "start_b", "n")


def _own(start: int, end: int, covered: list[tuple[int, int]]) -> int:
    """Tokens of [start, end) outside ``covered``, sorted intervals that do not touch."""
    at = max(0, bisect_right(covered, (start, float("inf"))) - 1)
    left = end - start
    for a, b in covered[at:]:
        if a >= end:
            break
        left -= max(0, min(end, b) - max(start, a))
    return left


def _cover(start: int, end: int, covered: list[tuple[int, int]]) -> None:
    """Add [start, end) to ``covered``."""
    first = bisect_left(covered, (start, start))
    if first and covered[first - 1][1] >= start:
        first -= 1
    last = first
    while last < len(covered) and covered[last][0] <= end:
        start, end, last = min(start, covered[last][0]), max(end, covered[last][1]), last + 1
    covered[first:last] = [(start, end)]


def _verdicts(least: int, own: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair's rows follow each other, longest first; only what the current pair covers is kept.
        pair, sides = None, ([], [])
        for rows in batches:
            out = []
            for *key, a, b, n in zip(*(rows.column(c).to_pylist() for c in COLUMNS)):
                if key != pair:
                    pair, sides = key, ([], [])
                if n < least:
                    out.append("dropped")
                elif min(_own(s, s + n, side) for s, side in zip((a, b), sides)) < own:
                    out.append("suppressed")
                else:
                    out.append("reported")
                    for s, side in zip((a, b), sides):
                        _cover(s, s + n, side)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in COLUMNS), pa.array(out, pa.string())], [*COLUMNS, "verdict"])

    return judge


def coverage(runs: DataFrame, least: int, own: int) -> DataFrame:
    """``runs`` (id_a, id_b, start_a, start_b, n) with ``verdict``.

    ``dropped``: shorter than ``least``. Of the others of a pair, longest first and then in the
    order of their starts, one is ``reported`` if on both sides ``own`` of its tokens or more lie
    outside those reported before, else ``suppressed``. Pairs are spread over the tasks and sorted
    there; a task goes through its rows once, so neither many pairs nor a pair of many runs is
    gathered.
    """
    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.select("id_a", "id_b").schema.fields)
    rows = runs.selectExpr("id_a", "id_b", "cast(start_a as bigint) start_a", "cast(start_b as bigint) start_b", "cast(n as bigint) n")
    by_pair = rows.repartition("id_a", "id_b").sortWithinPartitions("id_a", "id_b", F.desc("n"), "start_a", "start_b")
    return by_pair.mapInArrow(_verdicts(least, own), f"{ids}, start_a long, start_b long, n long, verdict string")

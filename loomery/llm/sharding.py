"""Shards of near-equal bytes that keep equal texts together.

Minimax contiguous partition. All groups of equal texts are put in the order of a 64-bit hash
of their text, and cut into contiguous runs, one per shard, so that the largest run is as small
as it can be: a binary search over the capacity, each candidate checked by filling shards
greedily. Groups larger than an equal share of what is left cannot be balanced by any cut; at
most one per shard exists, they come first in the order and take a shard each.

The search runs on the driver over a bounded table. Groups are summed into 2**BITS ranges of
the hash; only where the search needs to look inside a range is that range summed again into
finer ones, one Spark aggregation for all such ranges. A cut is thus a hash value, and a row
learns its shard by comparing its own hash with at most ``shards`` numbers: no row is moved for
it, however large its group.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.common import store, whole_text

#: Ranges of the first summary, and how finely one range is split when the search looks inside.
BITS, SPLIT_BITS = 14, 8
#: Rows that share a numbering task inside a shard, on average, once there are many rows.
ROWS_PER_RUN = 50_000
MIN_RUNS = 192
LOW = -(1 << 63)


def _summary(groups: DataFrame, shift: int) -> DataFrame:
    """Ranges of 2**shift hashes: index, bytes, smallest and largest hash inside."""
    return groups.groupBy(F.expr(f"shiftright(h, {shift})").alias("r")).agg(
        F.sum("size").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")
    )


class _Ladder:
    """Prefix sums over ranges of hashes, refined where a lookup falls inside a range."""

    def __init__(self, groups: DataFrame, bits: int, split_bits: int):
        self.groups, self.split_bits = groups, split_bits
        self.shift = 64 - bits
        self.cells = {(x.lo, x.hi): (x.bytes, self.shift) for x in _summary(groups, self.shift).collect()}
        self.wanted: set[tuple[int, int]] = set()
        self._index([])

    def _index(self, without: list[int]) -> None:
        self.order = sorted(k for k in self.cells if not (k[0] == k[1] and k[0] in without))
        self.ends, total = [], 0
        for k in self.order:
            total += self.cells[k][0]
            self.ends.append(total)
        self.total, self.without = total, list(without)

    def fill(self, start: int, room: int) -> int:
        """The largest group boundary at most ``start + room``; notes the range it falls into."""
        i = bisect_right(self.ends, start + room)
        if i < len(self.order):
            lo, hi = self.order[i]
            if lo != hi:
                self.wanted.add(self.order[i])
        return self.ends[i - 1] if i else 0

    def refine(self) -> None:
        """Split the noted ranges further, with one aggregation over the groups."""
        wanted, self.wanted = sorted(self.wanted), set()
        by_shift: dict[int, list[tuple[int, int]]] = {}
        for k in wanted:
            by_shift.setdefault(self.cells[k][1], []).append(k)
        for shift, keys in by_shift.items():
            finer = max(0, shift - self.split_bits)
            inside = F.expr(f"shiftright(h, {shift})").isin([k[0] >> shift for k in keys])
            rows = _summary(self.groups.where(inside), finer).collect()
            for k in keys:
                del self.cells[k]
            self.cells |= {(x.lo, x.hi): (x.bytes, finer) for x in rows}
        self._index(self.without)

    def largest(self) -> tuple[tuple[int, int], int] | None:
        k = max(self.order, key=lambda k: self.cells[k][0], default=None)
        return None if k is None else (k, self.cells[k][0])

    def end_hash(self, boundary: int) -> int:
        """The last hash before a group boundary."""
        i = bisect_right(self.ends, boundary)
        return self.order[i - 1][1] if i else LOW


def _greedy(ladder: _Ladder, room: int, shards: int) -> list[int]:
    cuts, at = [], 0
    for _ in range(shards):
        at = max(at, ladder.fill(at, room))
        cuts.append(at)
    return cuts


def minimax_cuts(groups: DataFrame, shards: int, bits: int = BITS, split_bits: int = SPLIT_BITS) -> tuple[list[int], list[int]]:
    """(hashes of groups with a shard of their own, last hash of each further shard).

    ``groups`` has ``h`` and ``size``, any number of rows per hash. The driver holds 2**bits
    ranges and at most 2**split_bits more for each cut of each step of the search.
    """
    ladder = _Ladder(groups, bits, split_bits)
    own: list[int] = []
    while shards - len(own) > 1 and (top := ladder.largest()) and top[1] * (shards - len(own)) > ladder.total:
        (lo, hi), _ = top
        if lo == hi:
            own.append(lo)
            ladder._index(own)
        else:
            ladder.wanted.add((lo, hi))
            ladder.refine()
    left = shards - len(own)
    # The share of an equal cut is too little or just enough; one more largest range is enough.
    low, high = max(0, -(-ladder.total // left) - 1), ladder.total
    while high - low > 1:
        mid = (low + high) // 2
        ladder.wanted.clear()
        ends = _greedy(ladder, mid, left)
        if ends[-1] >= ladder.total:
            high = mid
        elif not ladder.wanted:
            low = mid
        elif _optimist(ladder, mid, left) < ladder.total:
            low = mid
        else:
            ladder.refine()
    # Filling to the capacity would leave the last shards short: every cut goes as near to an
    # equal share of the rest as the capacity lets it, and as the rest can still be placed.
    while True:
        ladder.wanted.clear()
        cuts = _even(ladder, high, left)
        if not ladder.wanted:
            return own, [ladder.end_hash(c) for c in cuts[:-1]]
        ladder.refine()


def _optimist(ladder: _Ladder, room: int, shards: int) -> int:
    """An upper bound of what ``shards`` shards can hold: cuts may fall inside ranges."""
    at = 0
    for _ in range(shards):
        i = bisect_right(ladder.ends, at + room)
        if i >= len(ladder.order):
            return ladder.total
        lo, hi = ladder.order[i]
        at = (ladder.ends[i - 1] if i else 0) if lo == hi else at + room
    return at


def _even(ladder: _Ladder, room: int, shards: int) -> list[int]:
    """Cuts that respect ``room`` and come near equal shares."""
    need, at = [ladder.total], ladder.total
    for _ in range(shards - 1):  # from the right: the least that must be placed before each cut
        i = bisect_right(ladder.ends, at - room - 1)
        at = min(at, ladder.ends[i]) if at > room else 0
        if at and ladder.order[i][0] != ladder.order[i][1]:
            ladder.wanted.add(ladder.order[i])
        need.append(at)
    need.reverse()
    cuts, at = [], 0
    for k in range(shards):
        most = ladder.fill(at, room)
        share = at + -(-(ladder.total - at) // (shards - k))
        below = ladder.fill(0, share)
        i = bisect_right(ladder.ends, share)
        above = ladder.ends[i] if i < len(ladder.ends) else ladder.total
        best = above if above - share < share - below else below
        at = max(at, min(most, max(need[k], best)))
        cuts.append(at)
    return cuts


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus the eight bytes of its record's length."""
    return F.octet_length(whole_text(text)).cast("long") + 8


def _shard(h: Column, own: list[int], last: list[int]) -> Column:
    out = F.lit(len(own) + len(last))
    for k in range(len(last) - 1, -1, -1):
        out = F.when(h <= F.lit(last[k]), F.lit(len(own) + k)).otherwise(out)
    for k, v in enumerate(own):
        out = F.when(h == F.lit(v), F.lit(k)).otherwise(out)
    return out.cast("int")


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row.

    Rows of equal text share a shard; null texts count as empty. ``slot`` numbers the rows of a
    shard without gaps; repeated rows get numbers of their own. An empty table gives no rows, and
    with fewer groups than shards some shards stay empty. Other columns are ignored.
    """
    text = whole_text(F.col(text_col))
    rows = store(
        docs.select(
            F.col(id_col).alias("id"),
            byte_size(F.col(text_col)).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = store(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    own, last = minimax_cuts(groups, shards)
    # A shard is numbered in runs: rows are dealt to runs by a hash of their stored number, so that
    # repeated rows spread like any others, the few counts of the runs are summed up, and each run
    # numbers its rows from there.
    runs = max(MIN_RUNS, rows.count() // (ROWS_PER_RUN * shards))
    placed = rows.withColumn("shard", _shard(F.col("h"), own, last)).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "row")))
    return numbered.join(counts.select("shard", "run", before.alias("before")), ["shard", "run"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("k") - 1).alias("slot")
    )

"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

Vectors are assigned to the nearest of a set of centres (k-means, fitted in numpy on a bounded
sample); every row is indexed. A query probes the lists of its nearest centres. Vectors are
rotated by a random orthogonal matrix, so that the first d of D rotated columns hold a share of a
squared distance that follows a Beta(d/2, (D-d)/2) law. A list is scanned in chunks of rows and
blocks of columns: after each block a hypothesis test abandons the candidates whose partial
distance is so large that a candidate as near as the k-th nearest seen so far would show it with
a chance of ERROR at most; only survivors read the next block, and after each chunk the k-th
nearest is taken anew, so the bound tightens as the scan goes on. What is left is ranked by the
exact distance on the original vectors in double precision. A true neighbour is lost by a test
with a chance of ERROR, and by all tests of a list with one of ERROR times the column blocks.

Lists are cut into blocks of rows and the queries of a list into blocks of queries, as many as
that list has, so neither a vector that a third of all rows have nor a query set that grows with
the table meets in one task; each task keeps a query's best of its block only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.common import store, worker_path

#: Rows that the centres are fitted on, by a hash of the id.
SAMPLE_ROWS = 20_000
ROWS_PER_LIST, ROUNDS, SEED = 200, 8, 11
#: Lists grow with the rows, then with their root, up to what the sample can place.
FEW_LISTS, MAX_LISTS = 1024, SAMPLE_ROWS // 4
#: Probes are set so that lists of this share of the true neighbours are visited, measured on so
#: many queries of the sample, whose neighbours are farther and thus harder than those of all rows.
TARGET, TRIALS, MIN_PROBES = 0.96, 200, 8
#: Rows of one list that a task scans at a time: a 400th of the table within these bounds, for a
#: query's vector is sent to every block. And queries that meet such a block at a time.
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCK_QUERIES = 512, 16_384, 8192
#: Columns between two tests, rows between two bounds, and the chance that a test abandons a
#: candidate that is nearer than the bound.
COLUMNS, CHUNK, ERROR = 16, 256, 1e-3


def share_limit(seen: int, width: int, error: float = ERROR) -> float:
    """The share of a squared distance that ``seen`` of ``width`` rotated columns exceed with chance ``error``."""
    if seen >= width:
        return 1.0
    a, b, n = seen / 2, (width - seen) / 2, 20_000
    x = (np.arange(n) + 0.5) / n
    density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / n
    above = np.cumsum(density[::-1])[::-1]
    return float(x[min(n - 1, int(np.searchsorted(-above, -error)))])


def fit_centres(x: np.ndarray, lists: int) -> np.ndarray:
    """k-means centres of the sample's distinct vectors, at most ``lists``."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(SEED)
    c = x[rng.permutation(len(x))[: max(1, lists)]].copy() if len(x) else np.zeros((0, x.shape[1]))
    for _ in range(ROUNDS if len(x) else 0):
        own = np.concatenate([_nearest(x[i : i + 4096], c, 1)[:, 0] for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    d = (c * c).sum(1)[None, :] - 2 * x @ c.T
    near = np.argpartition(d, min(k, len(c)) - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many lists hold TARGET of the k true neighbours of sample rows among the sample."""
    x = np.unique(x, axis=0)
    q = np.random.default_rng(SEED).permutation(len(x))[:TRIALS]
    if len(centres) <= MIN_PROBES or len(x) <= k:
        return len(centres)
    own = np.concatenate([_nearest(x[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(x), 4096)])
    true = _nearest(x[q], x, k + 1)[:, 1:]
    place = np.argsort(_nearest(x[q], centres, len(centres)), axis=1)
    depth = np.sort(np.take_along_axis(place, own[true], 1).ravel())
    return max(MIN_PROBES, int(depth[int(np.ceil(TARGET * len(depth))) - 1]) + 1)


def scan(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, turn: np.ndarray) -> list[tuple[int, int, float]]:
    """(query index, id, distance) of each query's k nearest rows, ties to the smaller id.

    ``own[i]`` is the query's own id, which is no candidate. Rows are taken in the order of ids.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    rq, rr = (queries @ turn).astype(np.float32), (rows @ turn).astype(np.float32)
    width, out = rows.shape[1], []
    tests = [(at, min(at + COLUMNS, width)) for at in range(0, width, COLUMNS)]
    # A little more than the law says, for the single precision of the rotated columns.
    limits = [share_limit(end, width) * (1 + 1e-4) for _, end in tests]
    for i in range(len(queries)):
        mine, exact, bound = np.zeros(0, np.int64), np.zeros(0), np.inf
        others = np.flatnonzero(ids != own[i])
        for first in range(0, len(others), CHUNK):
            live = others[first : first + CHUNK]
            part = np.zeros(len(live), np.float32)
            for (at, end), limit in zip(tests, limits):
                diff = rr[live, at:end] - rq[i, at:end]
                part += np.einsum("ij,ij->i", diff, diff)
                stay = part <= bound * bound * limit + 1e-9
                live, part = live[stay], part[stay]
                if not len(live):
                    break
            mine = np.concatenate([mine, live])
            exact = np.concatenate([exact, np.sqrt(((rows[live] - queries[i]) ** 2).sum(1))])
            best = np.lexsort((ids[mine], exact))[:k]
            mine, exact = mine[best], exact[best]
            bound = exact[-1] if len(exact) == k else np.inf
        out += [(i, int(ids[j]), float(d)) for j, d in zip(mine, exact)]
    return out


def _usable(vector: str) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, query_every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest rows found.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows with
    another id. Vectors that are null, empty or all zero, or that hold a null or non-finite
    component, and rows without an id, take no part; nor do vectors whose length is not the most
    common one (of equally common ones the largest). An id that repeats is one query with its
    smallest vector, and one candidate that counts with its nearest vector. Fewer candidates than
    ``k`` give fewer rows. ``probes`` sets the lists per query; by default the sample tells. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    worker_path(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & _usable("v"))
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head(1)
    empty = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], empty)
    width, n = widths[0]["width"], widths[0]["count"]
    rows = rows.where(F.size("v") == width)

    some = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    lists = max(1, min(n // ROWS_PER_LIST, max(FEW_LISTS, isqrt(n)), MAX_LISTS))
    sample = np.stack(some.to_numpy()).astype(float)
    centres = fit_centres(sample, lists)
    probes = probes or probes_needed(sample, centres, k)
    turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))[0]
    held = spark.sparkContext.broadcast((centres, turn))

    def assign(count: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value[0]
            for b in batches:
                for at in range(0, len(b), 2048):
                    part = b.iloc[at : at + 2048]
                    near = _nearest(np.stack(part["v"].to_numpy()), c, count)
                    yield pd.DataFrame(
                        {"id": np.repeat(part["id"].to_numpy(), near.shape[1]), "v": np.repeat(part["v"].to_numpy(), near.shape[1]), "list": near.ravel().astype(np.int32)}
                    )

        return run

    # Every row in its list, in blocks by its stored number; every query in the lists it probes. A
    # list of so many blocks of rows and of queries is met in all pairs of these: rows are repeated
    # once per block of the queries that probe their own list.
    kind = "id long, v array<double>, list int"
    indexed = store(rows.mapInPandas(assign(1), kind).withColumn("row", F.monotonically_increasing_id()), "nearest-index")
    asked = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    probing = store(asked.mapInPandas(assign(probes), kind), "nearest-probes")
    block_rows = max(BLOCK_ROWS, min(MOST_BLOCK_ROWS, n // 400))
    # One row per list, of which there are MAX_LISTS at most.
    blocks = indexed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    turns = probing.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns"))
    sizes = F.broadcast(store(blocks.join(turns, "list"), "nearest-sizes"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    indexed = indexed.join(sizes, "list").select("list", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), every("turns").alias("turn"), F.lit(False).alias("asks"), "id", "v")
    probing = probing.join(sizes, "list").select("list", every("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("turns")).cast("int").alias("turn"), F.lit(True).alias("asks"), "id", "v")

    def visit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy()
        q, r = part[asks], part[~asks]
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, vs = q["id"].to_numpy(), np.stack(q["v"].to_numpy())
        found = scan(vs, np.stack(r["v"].to_numpy()), ids, r["id"].to_numpy(), k, held.value[1])
        i, vec, score = zip(*found) if found else ((), (), ())
        return pd.DataFrame({"query_id": ids[list(i)], "vec_id": list(vec), "score": list(score)})

    both = indexed.unionByName(probing)
    found = both.groupBy("list", "block", "turn").applyInPandas(visit, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

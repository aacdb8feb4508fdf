"""Packing documents into sequences: concatenate and cut.

All token streams, one behind the other, are cut into windows of a fixed number of tokens. The
first pass tokenises: every partition writes its documents' ids with their running offset inside
the partition. Partition totals, a table of one row per partition, are summed up into the global
offset of each partition. The second pass reads the ids back and cuts each document where a
window ends; a document over a boundary leaves one record in each window it touches. Nothing is
shuffled but the totals, and a long document is work for the task that reads it, nothing more.

The rest after the last full window is cut into windows whose lengths are powers of two, so no
window needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.common import map_arrow, maybe_broadcast, store, whole_text
from loomery.llm.tokens import word_encoder
from loomery.llm.words import blocks

MAX_TOKENS = 4096
END_ID = 2
TOKENS = "doc_id long, part int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def windows(start: int, length: int, total: int, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(position, length, window, offset in it, window's length) of each part of a document.

    The document is [start, start + length) of ``total`` tokens. Windows have ``size`` tokens up
    to the last full one; the rest is cut into powers of two, largest first.
    """
    full, end, at = total // size, start + length, start
    while at < end:
        name, wide = at // size, size
        first = name * size
        if name >= full:
            rest = total - first
            wide = 1 << (rest.bit_length() - 1)
            while at >= first + wide:
                first, rest, name = first + wide, rest - wide, name + 1
                wide = 1 << (rest.bit_length() - 1)
        take = min(end, first + wide) - at
        yield at - start, take, name, at - first, wide
        at += take


def _tokenise(encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]], end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, part = encoder(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for first, end in blocks(batch.column(1)):
                some = batch.slice(first, end - first)
                ids = [np.append(x, end_id) for x in encode(some.column(1))]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                before, at = at + np.cumsum(n) - n, at + int(n.sum())
                narrow = [x.astype("<u2" if x.max() < 65536 else "<u4").tobytes() for x in ids]
                yield _batch(TOKENS, [some.column(0), [part] * len(ids), before, n, narrow])

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, _KINDS[kind]) for (_, kind), c in zip(names, columns)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in names])


def _cut(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n, starts, totals = (b.column(k).to_pylist() for k in ("n", "start", "total"))
            rows: list[tuple] = []
            for i, ids in enumerate(b.column("ids")):
                raw = ids.as_buffer()
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[i] else "<u4").astype("<u4")
                for own, take, name, offset, length in windows(starts[i], n[i], totals[i], size):
                    rows.append((i, own, take, zlib.crc32(wide[own : own + take].tobytes()), n[i], name, offset, length))
            at, *rest = (list(x) for x in zip(*rows))
            yield _batch(PIECES, [b.column("doc_id").take(pa.array(at)), *rest])

    return run


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]] = word_encoder,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, with the sequence and the offset in it where each lies.

    ``encoder`` makes, once per task, the function from texts to ids. Null texts count as empty
    and consist of the end id alone. A null id gives pieces with a null id. Repeated rows are
    packed once per row. An empty table gives no pieces. Other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    tokens = store(map_arrow(plain, _tokenise(encoder, end_id), TOKENS), "pack-ids")
    # One row per partition of the first pass.
    parts = tokens.groupBy("part").agg(F.sum("n").alias("sum"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("sum").over(Window.partitionBy(F.lit(0)))
    parts = parts.select("part", (F.sum("sum").over(upto) - F.col("sum")).alias("base"), total.alias("total"))
    placed = tokens.join(maybe_broadcast(parts), "part")
    placed = placed.select("doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("start"), "total")
    return map_arrow(placed, _cut(max_tokens), PIECES)

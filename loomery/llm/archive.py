"""WARC archives of captured pages, and the ordered index of what they hold.

Writing: every page becomes one record. Of pages with equal payloads the one with the largest id
is a ``response`` with the payload; the others are ``revisit`` records that point at it and carry
no payload. Records are whole strings in UTF-8 and a record ends with two line ends, so Spark's
text writer with that separator produces valid WARC files in the shared folder, with its usual
commit of finished tasks; a lost executor leaves no half-written archive behind. A row of that
text is the content of one archive, cut where its bytes are enough whatever the sizes of its pages.

Reading: archives are read as bytes and cut by Content-Length, the only thing that tells where a
payload ends. Each archive gives a run of index entries sorted by (URL key, timestamp, page id).
The entries are dealt into ranges of that whole key, so captures of one URL may fall into several
ranges, and within each range the runs are merged by a loser tree. What comes out is the history
of every URL in one global order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.common import map_arrow, maybe_broadcast, scratch_path, store, whole_text

END = "\r\n\r\n"
#: Bytes after which an archive ends: what a task holds when it reads one, unless one page is larger.
ARCHIVE_BYTES = 8 << 20
#: Index entries per range of the merge, on average.
RANGE_ROWS = 20_000
EPOCH = datetime(2026, 1, 1, tzinfo=timezone.utc)


def capture_time(page_id: int) -> str:
    """Pages have no capture time of their own: one second per id from a fixed start."""
    return (EPOCH + timedelta(seconds=page_id % (1 << 32))).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then the rest, in lower case; as it is if it can't be read."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.strip().lower()
    path = parts.path.rstrip("/") or "/"
    return f"{','.join(reversed(host.split('.')))}{port}){path}{'?' + parts.query if parts.query else ''}".lower()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str | None, html: str, digest: str, response: int | None, is_response: bool) -> str:
    """One WARC record without the two line ends behind it."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    head = ["WARC/1.0", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    head.append(f"WARC-Date: {capture_time(page_id or 0)}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}"
    if not is_response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(response)}"]
        html = ""
    block = http + html
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + END + block


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of one archive after the other, without the two line ends behind its last record."""
    out, held = [], 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(out)], pa.string())], ["value"])
    for b in batches:
        for page, url, html, sha, top, own in zip(*b.columns):
            digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
            record = _record(page.as_py(), url.as_py(), html.as_py(), digest, top.as_py(), own.as_py())
            size = len(record.encode())
            if out and held + size > ARCHIVE_BYTES:
                yield done()
                out, held = [], 0
            out.append(record)
            held += size
    if out:
        yield done()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row of ``pages``, in WARC files below ``path``."""
    html = whole_text(F.col(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # Of equal payloads the largest id; ids that are null come before all others. Only payloads
    # that repeat need a table, and pages that are alone answer for themselves.
    tops = store(rows.groupBy("sha").agg(F.max("page").alias("most"), F.count("*").alias("of")).where("of > 1").select("sha", "most"), "warc-tops")
    met = rows.join(maybe_broadcast(tops.withColumn("again", F.lit(True))), "sha", "left")
    top = F.when(F.col("again"), F.col("most")).otherwise(F.col("page"))
    placed = met.select("page", "url", "html", "sha", top.alias("top"), F.col("page").eqNullSafe(top).alias("own"))
    map_arrow(placed, _archives, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def parse_archive(data: bytes) -> Iterator[tuple]:
    """(offset, length, type, page id, URL, date, digest, id referred to, payload bytes, digest holds) of each record.

    For a revisit the payload's bytes are unknown (None).
    """
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, n = head_end + 4, int(head["Content-Length"])
        block = data[start : start + n]
        end = start + n + 4
        if len(block) != n or data[start + n : end] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        page = lambda x: None if x in (None, "<urn:page:none>") else int(x[len("<urn:page:") : -1])
        own = head["WARC-Type"] == "response"
        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
        refers = page(head.get("WARC-Refers-To"))
        yield (at, end - at, head["WARC-Type"], page(head["WARC-Record-ID"]), url, head["WARC-Date"], digest, refers, len(payload) if own else None, not own or base32_sha1(payload) == digest)
        at = end


ENTRY = "run string, record_offset long, record_length long, record_type string, page_id long, url_key string, captured string, payload_digest string, refers_to long, payload_bytes long"
_ENTRY = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in ENTRY.split(", ")])


def _order(row: tuple) -> tuple:
    """URL key (null first), timestamp, page id (null first)."""
    return (row[5] is not None, row[5] or "", row[6], row[4] is not None, row[4] or 0)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of each archive."""
    for b in batches:
        for path, content in zip(*b.columns):
            rows = []
            for at, n, kind, page, url, date, digest, refers, size, holds in parse_archive(content.as_py()):
                if not holds:
                    raise ValueError(f"{path}: the payload at byte {at} does not have its digest")
                rows.append((path.as_py(), at, n, kind, page, None if url is None else url_key(url), date, digest, refers, size))
            rows.sort(key=_order)
            yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, r)) for r in rows], _ENTRY)


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple]:
    """k sorted runs as one sorted sequence, by a tree of losers: one comparison per level for each row.

    Leaves are the runs' next keys; each inner node keeps the run that lost there, and the winner
    of all goes out and is replaced by its run's next row, which plays its way up again.
    """
    k = len(runs)
    heads = [0] * k
    done = (True,)
    key = lambda i: (False, _order(runs[i][heads[i]]), i) if heads[i] < len(runs[i]) else done
    keys = [key(i) for i in range(k)]
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while k and keys[best] is not done:
        yield runs[best][heads[best]]
        heads[best] += 1
        keys[best] = key(best)
        node = (best + k) // 2
        while node:
            if keys[losers[node]] < keys[best]:
                best, losers[node] = losers[node], best
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of keys: its slices of the runs arrive run by run, each in order, and leave merged."""
    runs: dict[str, list[tuple]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(row[0], []).append(row)
    part, schema = TaskContext.get().partitionId(), _ENTRY.append(pa.field("part", pa.int32())).append(pa.field("k", pa.int64()))
    out = []
    for k, row in enumerate(merge_runs(list(runs.values()))):
        out.append(dict(zip(schema.names, (*row, part, k))))
        if len(out) == 8192:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def capture_history(entries: DataFrame) -> DataFrame:
    """Index entries with ``position``, their place in the one order of all captures."""
    whole = ["url_key", "captured", "page_id", "run", "record_offset"]
    ranges = max(1, entries.count() // RANGE_ROWS + 1)
    dealt = entries.repartitionByRange(ranges, *whole).sortWithinPartitions("run", "url_key", "captured", "page_id")
    merged = store(map_arrow(dealt, _merge, f"{ENTRY}, part int, k long"), "warc-merged")
    parts = merged.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    base = (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")
    placed = merged.join(maybe_broadcast(parts.select("part", base)), "part")
    return placed.withColumn("position", F.col("base") + F.col("k")).drop("part", "k", "base")


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to WARC archives below ``path`` (a new shared folder) and read their index back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    captured, run, record_offset, record_length and position. Null html is the empty payload, and
    empty payloads are equal like any others. Rows that repeat with the largest id of their
    payload are all responses. A page with a null id revisits, unless all ids of its payload are
    null; these are responses. Pages without URL sort first. No pages give no rows. Other columns
    are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").where("length > 0")
    entries = store(map_arrow(files, _entries, ENTRY), "warc-runs")
    history = capture_history(entries)
    # A revisit's payload is that of the response with its digest; a response tells its own.
    history = store(history, "warc-history")
    again = history.where("record_type = 'revisit'").drop("payload_bytes")
    size = history.where("record_type = 'response'").join(again.select("payload_digest").distinct(), "payload_digest", "left_semi")
    size = store(size.groupBy("payload_digest").agg(F.max("payload_bytes").alias("bytes")), "warc-sizes")
    out = history.where("record_type = 'response'").withColumnRenamed("payload_bytes", "bytes").unionByName(again.join(maybe_broadcast(size), "payload_digest"))
    first = [F.col("page_id").alias(id_col), F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    return out.select(*first, "url_key", "captured", "run", "record_offset", "record_length", "position")

"""Personal data: fixed patterns, and terms that give away what the patterns protect.

The base patterns find addresses, hosts, cards and phone numbers. Each of them, brought to one
spelling, is a protected entity. A word that stands beside an entity again and again and hardly
anywhere else (a name, a nickname, an account) discloses it even where the entity itself is
removed. How much it does is pointwise mutual information against the information of the entity:

    strength = log(n(c, t) * N / (n(c) * n(t))) / log(N / n(c))

with N texts, n(c) with the entity, n(t) with the term anywhere and n(c, t) with the term within
AROUND characters of the entity. It is 1 for a term that is met with the entity only. From
GENERALISE on a term is replaced by its class, from REMOVE on it is taken out, wherever it stands.
Evidence has to come from at least SUPPORT texts, and from surroundings that differ in their least
and in their greatest word (by hash) besides the term: copies of one text are no further evidence.

Three scans: entities with the terms around them; in how many texts each candidate occurs; the
spans. What the last two know of the candidates is a bit map of a fixed size, which lets a few
other words pass; an exact join behind each scan removes these. The candidates themselves, their
counts and strengths are tables that Spark joins, whatever their size.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.bits import bit_map, holds
from loomery.llm.common import map_arrow, maybe_broadcast, store, whole_text
from loomery.llm.words import Memo, blocks, coded

# The base patterns. Written so that each character is read a few times at most.
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP, PART_MOST = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), 255
CARD, CARD_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+"), range(16, 20)
PHONE, PHONE_DIGITS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), range(8, 16)

BASE = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
AROUND, SUPPORT = 160, 3
GENERALISE, REMOVE = 0.8, 0.95
#: log2 of the bits of the maps of candidates.
BITS = 23
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
DIGITS = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ that a domain follows, back over what may stand before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= PART_MOST


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and without overlap per kind, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        # A run may be megabytes of digits: only one of a card's length is looked at.
        if m.end() - m.start() < 2 * CARD_DIGITS.stop:
            digits = "".join(DIGITS.findall(m[0]))
            if len(digits) in CARD_DIGITS and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if len(DIGITS.findall(m[0])) in PHONE_DIGITS]
    return out


def _entity(text: str, kind: int, start: int, end: int) -> str:
    """One key for every spelling of an entity."""
    value = text[start:end]
    value = value.lower() if kind < 2 else "".join(DIGITS.findall(value))
    return f"{BASE[kind]}:{xxhash.xxh3_128_hexdigest(value)}"


def term_of(word: str) -> str:
    """The word in lower case without what is neither letter nor digit at its ends."""
    return EDGE.sub("", word).lower()


def _hash(term: str) -> int:
    """Spark's xxhash64 of the string, in 0 to 2**64 - 1."""
    return xxhash.xxh64_intdigest(term, seed=42)


def _buckets(terms: list[str]) -> np.ndarray:
    return np.fromiter((_hash(t) & (1 << BITS) - 1 for t in terms), np.int64, len(terms))


def _map_of(terms: DataFrame) -> np.ndarray:
    return bit_map(terms.select(F.xxhash64("term").bitwiseAND(F.lit((1 << BITS) - 1)).alias("bucket")), BITS)


def surroundings(text: str) -> dict[tuple[str, str], list[int]]:
    """(entity, term): least and greatest of both marks of the windows where they meet; the term '' is the entity alone.

    The marks of a window are the least and the greatest hash of its words besides the term. Words
    that touch a base span or the border of the window are not in it.
    """
    spans, out = base_spans(text), {}
    starts, ends_of = _covered(spans)
    for kind, a, b in spans:
        key, terms = _entity(text, kind, a, b), {}
        out.setdefault((key, ""), [0, 0, 0, 0])
        for low, high in ((a - AROUND, a), (b, b + AROUND)):
            low, high = max(0, low), min(len(text), high)
            # One character more on either side shows which words the border cuts.
            edge = max(0, low - 1)
            for m in WORD.finditer(text, edge, min(len(text), high + 1)):
                x, y = m.span()
                near = bisect_right(ends_of, x)
                if x < low or y > high or (near < len(starts) and starts[near] < y):
                    continue
                if t := term_of(m[0]):
                    terms[t] = _hash(t) >> 1
        ends = sorted(terms.values())
        for t, h in terms.items():
            least, most = (ends[h == ends[0]], ends[-2 if h == ends[-1] else -1]) if len(ends) > 1 else (0, 0)
            held = out.setdefault((key, t), [least, least, most, most])
            held[0], held[1] = min(held[0], least), max(held[1], least)
            held[2], held[3] = min(held[2], most), max(held[3], most)
    return out


def _covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together: spans of several kinds may overlap."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _surrounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["entity", "term", "least_a", "least_b", "most_a", "most_b"]
    for b in batches:
        rows = [(*k, *v) for t in b.column("text") for k, v in surroundings(t.as_py()).items()]
        if rows:
            kinds = [pa.string()] * 2 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class _Terms:
    """Words of texts, as the terms that a bit map lets pass."""

    def __init__(self, held: np.ndarray):
        self.held = held
        self.memo = Memo(self._look)

    def _look(self, words: list[str]) -> list[str]:
        terms = [term_of(w) for w in words]
        passed = holds(self.held, _buckets(terms)) if terms else []
        return [t if ok and t else "" for t, ok in zip(terms, passed)]

    def occurring(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text, term) of every pair that occurs, and the terms."""
        codes, offsets, words = coded(pc.ascii_split_whitespace(texts.cast(pa.large_string())))
        found = self.memo(words)
        names = sorted({t for t in found if t})
        place = {t: i for i, t in enumerate(names)}
        own = np.array([place.get(t, -1) for t in found], np.int64)[codes] if words else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        pair = np.unique(text[own >= 0] * max(1, len(names)) + own[own >= 0])
        return pair // max(1, len(names)), pair % max(1, len(names)), names


def _frequencies(plain: DataFrame, terms: DataFrame) -> DataFrame:
    """term, texts: in how many texts each of the terms occurs."""
    held = plain.sparkSession.sparkContext.broadcast(_map_of(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Terms(held.value)
        for b in batches:
            for first, end in blocks(b.column("text")):
                _, term, names = seen.occurring(b.column("text").slice(first, end - first))
                n = np.bincount(term, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64())], ["term", "texts"])

    return map_arrow(plain.select("text"), run, "term string, texts long").groupBy("term").agg(F.sum("texts").alias("texts"))


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term, strength, action (``generalise`` or ``remove``) of every term that discloses some entity."""
    plain = docs.select(whole_text(F.col(text_col)).alias("text"))
    met = map_arrow(plain, _surrounding, "entity string, term string, least_a long, least_b long, most_a long, most_b long")
    differ = (F.min("least_a") < F.max("least_b")) & (F.min("most_a") < F.max("most_b"))
    met = store(met.groupBy("entity", "term").agg(F.count("*").alias("both"), differ.alias("differ")), "personal-met")
    entities = met.where("term = ''").select("entity", F.col("both").alias("own"))
    pairs = met.where((F.col("term") != "") & (F.col("both") >= support) & F.col("differ")).select("entity", "term", "both")
    pairs = store(pairs.join(maybe_broadcast(entities), "entity"), "personal-pairs")
    texts = plain.count()
    often = store(_frequencies(plain, pairs.select("term").distinct()), "personal-terms")
    n = F.lit(float(texts))
    strength = F.log(F.col("both") * n / (F.col("own").cast("double") * F.col("texts"))) / F.log(n / F.col("own"))
    rated = pairs.join(maybe_broadcast(often), "term").where(F.col("own") < texts).withColumn("strength", strength)
    best = rated.groupBy("term").agg(F.max("strength").alias("strength")).where(F.col("strength") >= generalise)
    return store(best.withColumn("action", F.when(F.col("strength") >= remove, "remove").otherwise("generalise")), "personal-disclosing")


def _spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{BASE[k]}:{a}:{b}" for k, a, b in spans)


_HITS = "array<struct<term: string, start: bigint, stop: bigint>>"


def _scan(plain: DataFrame, terms: DataFrame) -> DataFrame:
    """``plain`` with n_*, base and spans; its columns ``row`` and ``text`` are read, ``row`` is unique."""
    held = plain.sparkSession.sparkContext.broadcast(_map_of(terms))
    keep = [c for c in plain.columns if c != "text"]
    hit = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Terms(held.value)
        for b in batches:
            for first, end in blocks(b.column("text")):
                some = b.slice(first, end - first)
                texts = some.column("text")
                with_term = set(seen.occurring(texts)[0].tolist()) if held.value.any() else ()
                counts, base, hits = [], [], []
                for i, value in enumerate(texts):
                    t = value.as_py()
                    spans = base_spans(t)
                    counts.append([sum(s[0] == k for s in spans) for k in range(len(BASE))])
                    base.append(_spelled(spans))
                    hits.append(_hits(t, spans, seen) if i in with_term else [])
                n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in keep], *n, pa.array(base, pa.string()), pa.array(hits, hit)],
                    [*keep, *[f"n_{k}" for k in BASE], "base", "hits"],
                )

    more = T.DataType.fromDDL(f"{', '.join(f'n_{k} long' for k in BASE)}, base string, hits {_HITS}")
    schema = T.StructType([plain.schema[c] for c in keep] + more.fields)
    found = store(map_arrow(plain, run, schema), "personal-spans")
    each = found.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(maybe_broadcast(terms.select("term", "action")), "term")
    spans = F.struct("action", "start", "stop")
    more = each.groupBy("row").agg(F.array_sort(F.collect_list(spans)).alias("added"))
    more = more.select(F.col("row").alias("of"), F.array_join(F.transform("added", lambda s: F.concat_ws(":", s["action"], s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("added"))
    out = found.drop("hits").join(maybe_broadcast(store(more, "personal-added")), F.col("row") == F.col("of"), "left").drop("of")
    return out.withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("added"))).drop("added")


def _hits(text: str, spans: list[tuple[int, int, int]], seen: _Terms) -> list[dict]:
    """Terms of the map in the text, but for what a base span covers already."""
    starts, ends, at, out = *_covered(spans), 0, []
    found = [(m.start(), m[0]) for m in WORD.finditer(text)]
    for (start, word), t in zip(found, seen.memo([w for _, w in found])):
        if not t:
            continue
        # The extent is that of the word without its edges, in the case that it has.
        core = EDGE.sub("", word)
        a = start + word.index(core)
        b = a + len(core)
        while at < len(ends) and ends[at] <= a:
            at += 1
        if at == len(ends) or starts[at] >= b:
            out.append({"term": t, "start": a, "stop": b})
    return out


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """Every row: id, n_email, n_ip, n_card, n_phone (spans of each base pattern), base and spans.

    ``base`` and ``spans`` are strings of kind:start:end in code points, end exclusive, by kind (in
    the order of BASE, then of ADDED) and start, joined by commas; ``spans`` also has the terms to
    generalise or remove. Null texts count as empty. Rows are scanned one by one, so repeated rows
    agree; a null id stays null; an empty table gives no rows. Other columns are ignored.
    """
    terms = disclosing_terms(docs, text_col) if terms is None else terms
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    return _scan(plain, terms).drop("row").withColumnRenamed("doc_id", id_col)


def _replacement(kind: str, word: str) -> str:
    if kind in BASE:
        return f"[{kind}]"
    if kind == "remove":
        return "[...]"
    return "[number]" if any(c.isdigit() for c in word) else "[name]" if word[:1].isupper() else "[word]"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            if text and spans:
                cuts, at, parts = sorted((int(a), int(e), k) for k, a, e in (s.split(":") for s in spans.split(","))), 0, []
                for a, e, k in cuts:
                    # Spans of two kinds may overlap: what the first covers is gone already.
                    if a >= at:
                        parts += [text[at:a], _replacement(k, text[a:e])]
                    at = max(at, e)
                text = "".join([*parts, text[at:]])
            out.append(text)
        names = [n for n in b.schema.names if n != "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names], names)


def sanitised(docs: DataFrame, text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with base spans and generalised terms replaced by their class, and removed terms cut out.

    Same columns and rows; null texts stay null; an empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    terms = disclosing_terms(docs, text_col) if terms is None else terms
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    plain = inner.select(F.monotonically_increasing_id().alias("row"), *[c for c in inner.columns], whole_text(F.col(f"c{at}")).alias("text"))
    found = _scan(plain, terms).select(*[F.col(c).alias("text") if c == f"c{at}" else F.col(c) for c in inner.columns], "spans")
    out = map_arrow(found, _cleaned, T.StructType([f for f in found.schema.fields if f.name != "spans"]))
    return out.select(*[F.col("text" if i == at else f"c{i}").alias(c) for i, c in enumerate(names)])

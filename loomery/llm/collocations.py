"""Collocations: phrases of two and three words that occur together more often than their parts.

Texts become streams of tokens: A-Z in lower case, a full stop for every border between pieces,
words between them. Phrases are then found in three steps.

Sketches, a scan for each length: every phrase is counted under a hash bucket, so a bucket's sum is
an upper bound of what any of its phrases counts. A phrase enters only if its parts passed the scan
before, for no phrase is more frequent than its parts. Of each sketch the buckets that come to the
least count are kept, as a bit map of 2**bits bits; ``bits`` follows the number of words up to
MAX_BITS, beyond which the bound is looser, more phrases are counted, and the result is the same.

Automata: a shard is a run of tokens of one language. Its phrases whose buckets passed are the
candidates that the shard may hold; they go into an Aho-Corasick automaton with the delimiter on
both sides, which runs over the shard and counts all matches, overlapping ones included. A phrase
belongs to the shard in which it begins. A shard has a fixed number of tokens, so an automaton is
bounded whatever the corpus holds, and every text is read once.

Sums: a task adds up the counts of its shards and sends them as sorted, compressed lists, one for
each language and range of hashes; each range is summed by phrase, which is exact, and what stays
below the least count goes. There are the more ranges the more words there are, so that a range is
bounded. Parts are joined to phrases for the scores; all that follows are joins and groups on the
counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.bits import holds
from loomery.llm.common import map_arrow, maybe_broadcast, store, whole_text
from loomery.llm.words import Memo

# Borders of pieces, and what else is made alike.
BORDERS, CAPITALS = b".,;:!?\x0a\x0b\x0c\x0d", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALIKE = bytes.maketrans(CAPITALS + BORDERS + b"\t", CAPITALS.lower() + b"." * len(BORDERS) + b" ")
LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: log2 of the buckets of a sketch: one for each word, between these bounds (the larger is a bit map of 32 MB).
MIN_BITS, MAX_BITS = 16, 28
NOTHING, GUARD = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
#: log2 of the number of ranges of buckets that are added apart, and phrases that a task gathers before it sends them.
RANGES_BITS, SENT = 8, 1 << 21
#: The same for counted phrases: ranges follow the number of words, so many words to a range, between these bounds.
MIN_PARTS, MAX_PARTS, PART_WORDS, COUNTED = 6, 14, 1 << 22, 1 << 20
#: Tokens of a shard.
SHARD = 1 << 18
#: Parts a language's rows are ranked in before the best of each part are ranked together.
SPREAD = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Stream:
    """The tokens of some texts of one language, and which phrases the sketches let pass."""

    def __init__(self, texts: list[str], lang: str, memo: Memo):
        joined = b" . ".join(t.encode() for t in texts).translate(ALIKE).replace(b".", b" . ")
        tokens = pc.ascii_split_whitespace(pa.array([joined], pa.large_binary()).view(pa.large_string())).flatten().dictionary_encode()
        self.codes, self.words = tokens.indices.to_numpy(zero_copy_only=False), tokens.dictionary
        self.names = names = self.words.to_numpy(zero_copy_only=False).tolist()
        # Splitting leaves an empty token at a blank beginning or end: a border like any other.
        self.real = np.array([w not in (".", "") for w in names], bool)[self.codes] if names else np.zeros(0, bool)
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
        self.word_hash = _mix(np.array(memo(names), np.uint64) ^ seed) if names else np.zeros(0, np.uint64)
        self.hash = self.word_hash[self.codes]

    def buckets(self, length: int, bits: int) -> np.ndarray:
        """Bucket of the phrase of so many words that begins at each token (whether or not one does)."""
        n = max(0, len(self.hash) - length + 1)
        h = np.zeros(n, np.uint64)
        for j in range(length):
            h = _mix(h + self.hash[j : j + n])
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def passing(self, maps: list[np.ndarray], bits: int) -> list[np.ndarray]:
        """For each length up to one more than there are maps: which tokens begin a phrase that may enter.

        Those up to the number of maps are also in their own map.
        """
        out = [self.real]
        for length, held in enumerate(maps, 1):
            out[-1] = out[-1].copy()
            at = np.flatnonzero(out[-1])
            out[-1][at] = holds(held, self.buckets(length, bits)[at])
            out.append(out[-1][:-1] & out[-1][1:])
        return out


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    groups: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _word_memo() -> Memo:
    return Memo(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words])


def _sketch(docs: DataFrame, length: int, maps: list[np.ndarray], bits: int, least: int) -> np.ndarray:
    """The buckets of phrases of that length that come to ``least``, as a bit map.

    Every few million phrases a task sends, for each range of buckets, which of them it has and how
    often, as planes of bytes: sorted distances are small, and counts that are enough by themselves
    end at ``least``. A range's sums are dense, so adding needs the memory of one range.
    """
    held = docs.sparkSession.sparkContext.broadcast(maps)

    range_bits = max(6, bits - RANGES_BITS)
    size = 1 << range_bits

    def send(parts: list[np.ndarray]) -> pa.RecordBatch:
        bucket, n = np.unique(np.concatenate(parts), return_counts=True)
        n = np.minimum(n, least).astype("<u4")
        gap = np.diff(bucket & size - 1, prepend=0).astype("<i4")
        cuts = np.flatnonzero(np.diff(bucket >> range_bits, prepend=-1))
        gap[cuts] = bucket[cuts] & size - 1
        ends = [*cuts[1:].tolist(), len(bucket)]
        planes = [gap[x:y].tobytes() + n[x:y].tobytes() for x, y in zip(cuts.tolist(), ends)]
        planes = [np.frombuffer(p, np.uint8).reshape(-1, 4).T.tobytes() for p in planes]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts] >> range_bits, pa.int64()), pa.array(planes, pa.binary())], ["range", "planes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, parts = _word_memo(), []
        for b in batches:
            for lang, texts in _by_lang(b):
                stream = Stream(texts, lang, memo)
                parts.append(stream.buckets(length, bits)[stream.passing(held.value, bits)[-1]])
                if sum(map(len, parts)) >= SENT:
                    yield send(parts)
                    parts = []
        if parts:
            yield send(parts)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for planes in b.column("planes").to_pylist():
                gap, n = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(2, -1)
                total[np.cumsum(gap)] += n
        passed = np.packbits(total >= least, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([passed], pa.binary())], ["range", "passed"])

    sent = map_arrow(docs, run, "range long, planes binary")
    out = np.zeros((1 << bits - range_bits, size // 64), np.uint64)
    for r in sent.groupBy("range").applyInArrow(add, "range long, passed binary").toArrow().to_pylist():
        out[r["range"]] = np.frombuffer(r["passed"], np.uint64)
    held.unpersist()
    return out.reshape(-1)


def _count_shard(stream: Stream, first: int, starts: list[np.ndarray], hashes: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Candidates (phrases of more than one word) that begin in the shard from token ``first`` on, how often each does, and their ranges.

    ``hashes`` are the ranges of the phrases of each of these lengths, by the token they begin at.
    """
    end = min(first + SHARD, len(stream.codes))
    words, codes = stream.words, stream.codes[first : min(end + LONGEST - 1, len(stream.codes))]
    ranges = []
    guarded = []
    for length in range(2, LONGEST + 1):
        at = np.flatnonzero(starts[length - 1][first:end])
        at = at[_firsts(stream, first + at, length)]
        ranges.append(hashes[length - 2][first + at])
        own = [words.take(pa.array(codes[at + j])) for j in range(length)]
        guarded.append(pc.binary_join_element_wise(NOTHING, *own, NOTHING, GUARD))
    guarded = pa.concat_arrays(guarded)
    if not len(guarded):
        return guarded, np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton, patterns = ahocorasick.Automaton(), guarded.to_numpy(zero_copy_only=False).tolist()
    for i, p in enumerate(patterns):
        automaton.add_word(p, i)
    automaton.make_automaton()
    tokens = [stream.names[c] for c in codes.tolist()]
    limit = sum(map(len, tokens[: end - first])) + end - first
    found = np.fromiter(chain.from_iterable(automaton.iter(" " + " ".join(tokens) + " ")), np.int64).reshape(-1, 2)
    wide = np.fromiter(map(len, patterns), np.int64, len(patterns))
    own = found[found[:, 0] - wide[found[:, 1]] + 1 < limit, 1]
    return pc.utf8_slice_codeunits(guarded, 1, -1), np.bincount(own, minlength=len(patterns)), np.concatenate(ranges)


def _firsts(stream: Stream, at: np.ndarray, length: int) -> np.ndarray:
    """Places in ``at`` of the first of each distinct phrase."""
    if not len(at):
        return np.zeros(0, np.int64)
    key = stream.codes[at].astype(np.int64)
    for j in range(1, length):
        # Codes of phrases so far, made dense: no product can overflow.
        key = (np.unique(key, return_inverse=True)[1] if j > 1 else key) * len(stream.words) + stream.codes[at + j]
    return np.unique(key, return_index=True)[1]


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, a: every phrase of one to three words that occurs ``least`` times or more.

    The row of the empty phrase has the number of words of its language, ``least`` or not.
    """
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(F.col(text_col)).alias("text"))
    words = plain.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    bits = min(MAX_BITS, max(MIN_BITS, (int(words) // 5).bit_length()))
    maps: list[np.ndarray] = []
    for length in range(1, LONGEST + 1):
        maps.append(_sketch(plain, length, maps, bits, least))
    held = docs.sparkSession.sparkContext.broadcast(maps)
    part_bits = min(MAX_PARTS, max(MIN_PARTS, (int(words) // 5 // PART_WORDS).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counted = _word_memo(), Counted()
        for b in batches:
            for lang, texts in _by_lang(b):
                stream = Stream(texts, lang, memo)
                starts = stream.passing(held.value, bits)[:LONGEST]
                counted.add(lang, pa.array([""], pa.large_string()), np.array([stream.real.sum()]), np.zeros(1, np.int64))
                # Single words are parts, no candidates: the codes count them.
                n = np.bincount(stream.codes[starts[0]], minlength=len(stream.words))
                counted.add(lang, stream.words.filter(pa.array(n > 0)), n[n > 0], (stream.word_hash[n > 0] >> np.uint64(64 - part_bits)).astype(np.int64))
                hashes = [stream.buckets(length, part_bits) for length in range(2, LONGEST + 1)]
                for first in range(0, len(stream.codes), SHARD):
                    counted.add(lang, *_count_shard(stream, first, starts, hashes))
                    if counted.held >= COUNTED:
                        yield from counted.sent()
        yield from counted.sent()

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, new, waiting = None, [], 0
        for b in batches:
            for packed in b.column("packed").to_pylist():
                new.append(_unpacked(packed))
                waiting += new[-1].num_rows
                # Added when as many wait as are held, so each is added a few times at most.
                if waiting > max(COUNTED, sums.num_rows if sums else 0):
                    sums, new, waiting = _summed([sums, *new] if sums else new), [], 0
        sums = _summed([sums, *new] if sums else new)
        enough = sums.filter(pc.or_(pc.greater_equal(sums["a"], least), pc.equal(sums["phrase"], "")))
        lang = pa.repeat(pa.scalar(key[0].as_py(), pa.string()), enough.num_rows)
        yield from pa.table({"lang": lang, "phrase": enough["phrase"].cast(pa.string()), "a": enough["a"]}).to_batches(1 << 16)

    sent = map_arrow(plain, run, "lang string, part long, packed binary")
    return store(sent.groupBy("lang", "part").applyInArrow(total, "lang string, phrase string, a long"), "phrase-counts")


def _summed(tables: list[pa.Table]) -> pa.Table:
    """phrase, a (and part, where it is there): each phrase once."""
    t = pa.concat_tables(tables)
    keys = [c for c in t.column_names if c != "a"]
    return t.group_by(keys).aggregate([("a", "sum")]).rename_columns([*keys, "a"])


class Counted:
    """Counts that a task gathers, by language, until they are sent."""

    def __init__(self):
        self.tables: dict[str, list[pa.Table]] = {}
        self.held = 0

    def add(self, lang: str, phrases: pa.Array, n: np.ndarray, ranges: np.ndarray) -> None:
        t = pa.table({"phrase": phrases, "part": pa.array(ranges, pa.int64()), "a": pa.array(n, pa.int64())})
        self.tables.setdefault(lang, []).append(t)
        self.held += t.num_rows

    def sent(self) -> Iterator[pa.RecordBatch]:
        """What was gathered, a row for each range of a language: its phrases in order, so that they compress."""
        packer = zstandard.ZstdCompressor(level=3)
        for lang, tables in self.tables.items():
            t = _summed(tables)
            t = t.take(pc.sort_indices(t, [("part", "ascending"), ("phrase", "ascending")]))
            part, n = t["part"].to_numpy(), t["a"].to_numpy()
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*cuts[1:].tolist(), len(part)]
            packed = [packer.compress(_packed(t["phrase"].slice(x, y - x).to_pylist(), n[x:y])) for x, y in zip(cuts.tolist(), ends)]
            langs = pa.repeat(pa.scalar(lang, pa.string()), len(cuts))
            yield pa.RecordBatch.from_arrays([langs, pa.array(part[cuts]), pa.array(packed, pa.binary())], ["lang", "part", "packed"])
        self.tables, self.held = {}, 0


def _packed(phrases: list[str], n: np.ndarray) -> bytes:
    """How many there are, their counts in planes of bytes, and the phrases; none holds a line end."""
    planes = np.frombuffer(n.astype("<i8").tobytes(), np.uint8).reshape(-1, 8).T.tobytes()
    return len(phrases).to_bytes(8, "little") + planes + "\n".join(phrases).encode()


def _unpacked(packed: bytes) -> pa.Table:
    plain = zstandard.ZstdDecompressor().decompress(packed)
    size = int.from_bytes(plain[:8], "little")
    n = np.frombuffer(plain[8 : 8 + 8 * size], np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(-1)
    phrases = pc.split_pattern(pa.array([plain[8 + 8 * size :].decode()], pa.large_string()), "\n").flatten()
    return pa.table({"phrase": phrases, "a": pa.array(n, pa.int64())})


def _parted(phrases: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """``phrases`` of ``longest`` words with k, l, r and score of their lowest-scoring cut, the first of equals."""
    cuts = []
    for k in range(1, longest):
        for part, name in ((F.substring_index("phrase", " ", k), f"l{k}"), (F.substring_index("phrase", " ", k - longest), f"r{k}")):
            own = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias(name))
            phrases = phrases.withColumn("own", part).join(maybe_broadcast(own), (F.col("lang") == F.col("of")) & (F.col("own") == F.col("part"))).drop("of", "part", "own")
        # Exact: numerator and denominator are decimals of 38 digits, the quotient is whole.
        score = F.expr(f"(1000000BD * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return phrases.select("lang", "phrase", "words", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("c"))


def collocations(
    docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    ``a`` occurrences of the phrase, ``l`` and ``r`` of its parts at the lowest-scoring cut, ``n``
    words of the language. A phrase inside a longer one that has ``covered`` percent of its
    occurrences goes. Null and empty texts have no words, a null language is ``und``; repeated rows
    count each; ties are broken by phrase; an empty table gives no rows. Other columns are ignored.
    """
    counts = phrase_counts(docs, least, lang_col, text_col)
    sized = counts.withColumn("words", F.size(F.split("phrase", " ")))
    two, three = (store(sized.where((F.col("words") == n) & (F.col("phrase") != "")), f"phrases-{n}") for n in (2, 3))
    best = _parted(two, counts, 2).unionByName(_parted(three, counts, 3))
    inner = three.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "a")
    over = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("phrase = ''").select("lang", F.col("a").alias("n"))
    return last.join(maybe_broadcast(store(total, "phrase-totals")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

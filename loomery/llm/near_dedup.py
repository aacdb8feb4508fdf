"""Near-duplicate documents by a join on MinHash signature coordinates.

A document is the set of its word shingles. Documents with equal sets form a class at once. Each
class has a signature of COORDINATES minima; a pair of similarity ``t`` agrees on each of them
with probability ``t``, so it agrees on at least ``m`` of them but for a chance of MISS, which
fixes ``m``, the match threshold. Classes are posted under their coordinate-value pairs.

Prefix: with all coordinate-value pairs in one global order, rarest first, two classes that agree
on ``m`` coordinates meet in a list among the first ``n - m + 1`` of those ``n`` that occur more
than once anywhere; only these prefixes are posted, and a class with fewer than ``m`` is left out.
Passages that many documents share thus cost little: their lists come last in the order.

Count and skip: collisions are counted per pair over the prefix lists. A pair with ``m`` of them
is retained. Where a list stands in both orders bounds what the lists before and behind it can
add; a pair that cannot come to ``m`` is skipped. For the others the lists behind the prefixes
are merged in, and the pair is retained if all collisions come to ``m``.

Of a posting list every member is tried against one centre only, the member that shares the
largest part of its set (of a text and its edited copies that is the text), which makes as many
pairs as members. How many of its shingles a class shares with any other bounds its similarity to
all of them; pairs that this rules out are never formed. Pairs inside one component need no test,
since only components are asked for. Of two members of different components one at least is not
linked with the centre, and then the two can be linked only if their differences from the centre
overlap: with d and d' elements in which they differ from it, ``(d + d' - r * (n + n')) / 2``
elements at least have to be the same, r being (1 - t) / (1 + t), and that is never 0. So members
of one centre are posted once more, under their differences, rarest first and again only as far
as a partner must show up. Edits that copies made by themselves are shared with no one and cost
nothing. Long lists of one edit are first tried against one member, whose component most of them
join; only members that are then still in different components are paired. Retained pairs are
linked if the full sets are as similar as asked, which built-in array functions tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import map_arrow, maybe_broadcast, store, whole_text
from loomery.llm.words import Memo, blocks, coded
from loomery.operators import graph

COORDINATES = 64
#: Chance that a pair of exactly the asked similarity agrees on fewer than ``m`` coordinates.
MISS = 1e-6
SEED = 20260201
#: Members of a list of one edit from which on one of them is tried first.
LONG_LIST = 16


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest m for which a pair of that similarity has fewer than m matches with chance ``miss`` at most."""
    p, below, m = percent / 100, 0.0, 0
    while m < coordinates:
        below += comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """texts -> for each the sorted 64-bit hashes of its distinct shingles of ``width`` words.

    Words are separated by ASCII white space, A-Z in lower case. A text of fewer words is one
    shingle, the whole sequence; one without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(1 << 62, size=width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.memo = Memo(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words])

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lower = pa.array([t.as_py().encode().lower() for t in texts], pa.large_binary()).view(pa.large_string())
        codes, offsets, words = coded(pc.ascii_split_whitespace(lower))
        hashes = np.array(self.memo(words), np.uint64)
        # Splitting leaves an empty word where a text begins or ends with white space.
        real = np.array([bool(w) for w in words], bool)[codes] if words else np.zeros(0, bool)
        h = hashes[codes][real] if words else np.zeros(0, np.uint64)
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        k = self.width
        whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            whole += h[j : len(h) - k + 1 + j] * self.odd[j]
        whole = _mix(whole)
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield _mix((h[a:b] * self.odd[: b - a]).sum(keepdims=True) + self.odd[k : k + 1] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    one, two = s.sum(dtype=np.uint64), _mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _signer(coordinates: int) -> Callable[[np.ndarray], np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    a = rng.integers(1 << 31, size=coordinates, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(1 << 32, size=coordinates, dtype=np.uint32)

    def sign(s: np.ndarray) -> np.ndarray:
        x, low = (s >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(x), 2048):
            part = (x[at : at + 2048, None] * a + b).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low.view(np.int32)

    return sign


def _sketch(width: int, coordinates: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign = Shingler(width), _signer(coordinates)
        for b in batches:
            for first, end in blocks(b.column("text")):
                some = b.slice(first, end - first)
                n, k1, k2, sig = [], [], [], []
                for s in shingles(some.column("text")):
                    n.append(len(s))
                    one, two = _keys(s)
                    k1.append(one)
                    k2.append(two)
                    sig.append(sign(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("row"), some.column("h"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array(sig, pa.list_(pa.int32()))],
                    ["doc_id", "row", "h", "n", "k1", "k2", "sig"],
                )

    return run


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            for first, end in blocks(b.column("text")):
                found = list(shingles(b.column("text").slice(first, end - first)))
                k1, k2 = zip(*map(_keys, found))
                sets = pa.array([np.sort(s.view(np.int64)) for s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), sets], ["k1", "k2", "set"])

    return run


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES
) -> DataFrame:
    """Every row: id, n_shingles, component_id (smallest id it is linked with, in steps) and kept.

    Texts are linked when their sets of ``width``-word shingles have intersection over union of
    ``percent`` / 100 or more. One row of a component is kept, one that has its smallest id. Null
    texts count as empty; a row without words is linked with nothing and kept. Rows with a null id
    are linked with nothing, have a null component and are kept. Ids may repeat, with equal texts
    or others: rows are linked by their texts. An empty table gives no rows. Other columns are
    ignored.
    """
    return _marked(docs, width, percent, id_col, text_col, coordinates).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id and kept of every row."""
    m = least_matches(percent, coordinates)
    text = whole_text(F.col(text_col))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("h"), text.alias("text"))
    sketch = "doc_id long, row long, h long, n long, k1 long, k2 long, sig array<int>"
    rows = store(map_arrow(plain, _sketch(width, coordinates), sketch), "near-sketch")

    # Classes of equal sets, each named by its first row.
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = rows.where(linkable).groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = store(classes.select("k1", "k2", "n", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("node")), "near-classes")
    signed = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "sig")
    orders = store(_orders(signed, m), "near-orders")
    labels = _labels(orders, classes, plain, m, width, percent)

    # The smallest id of each component and the first of its rows, handed to its classes and from there to the rows.
    of = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of.groupBy("label").agg(F.min(F.struct("doc", "node")).alias("first")).select("label", F.col("first.doc").alias("component_id"), F.col("first.node").alias("keeper"))
    of = store(of.join(least, "label").select("k1", "k2", "n", "component_id", "keeper"), "near-named")
    out = rows.where(linkable).select("doc_id", "row", "h", "n", "k1", "k2").join(of, ["k1", "k2", "n"])
    out = out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("keeper")).alias("kept"))
    return out.unionByName(rows.where(~linkable).select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _orders(signed: DataFrame, m: int) -> DataFrame:
    """node, tokens: the coordinate-value pairs that some other class has too, rarest first; at least ``m``."""
    value = F.expr("(cast(pos as bigint) << 32) | (cast(v as bigint) & 4294967295)")
    tokens = signed.select("node", F.posexplode("sig").alias("pos", "v")).select("node", value.alias("token"))
    # Stored, here and below, so that both sides of the join come from a shuffle that adaptive
    # execution may split: a large group of near copies makes frequent tokens.
    common = store(tokens.groupBy("token").count().where("count > 1"), "near-common")
    met = tokens.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("all"))
    return met.where(F.size("all") >= m).select("node", F.transform("all", lambda x: x["token"]).alias("tokens"))


def _labels(orders: DataFrame, classes: DataFrame, plain: DataFrame, m: int, width: int, percent: int) -> DataFrame:
    """node, label: the smallest node of its component, for every node that is linked with one."""
    # Prefixes: a class in the lists of its first pairs, with its place (from 0) in its own order.
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.lit(m - 1))
    posted = store(orders.select("node", F.size("tokens").alias("len"), F.posexplode(prefix).alias("pos", "token")), "near-postings")
    shared = posted.groupBy("token").count().where("count > 1").select("token")
    posted = store(posted.join(shared, "token", "left_semi"), "near-shared")
    sets, facts = _met(posted, classes, plain, width, percent)
    posted = store(posted.join(facts, "node"), "near-alive")

    # The bound: 100 * i >= percent * (n + n' - i) must hold for an intersection i as large as can be.
    may = F.expr(f"least(free, free_b) * {100 + percent} >= {percent} * (n + n_b)")
    rank = F.struct((-F.col("free") / F.col("n")).alias("own"), F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "free", "pos", "len")])
    lists = store(posted.groupBy("token").agg(F.min(rank).alias("c")).select("token", "c.b", "c.n_b", "c.free_b", "c.pos_b", "c.len_b"), "near-lists")
    met = posted.join(lists, "token").where((F.col("node") != F.col("b")) & may)
    # Before, in and behind a list that both are in, at most so many pairs can be common to them.
    room = F.least("pos", "pos_b") + F.least(F.col("len") - F.col("pos"), F.col("len_b") - F.col("pos_b"))
    stars = met.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("met"), F.min(room).alias("room"))
    stars = store(stars.where((F.col("met") >= m) | (F.col("room") >= m)).select("a", "b", "met"), "near-stars")
    linked = _linked(stars, orders, sets, m, percent)
    labels = _joined([linked])

    # Centres whose members are still in more than one component.
    named = posted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    around = named.join(lists.select("token", "b", "n_b"), "token").select(F.col("node").alias("a"), "b", "n", "free", "label", "n_b").distinct()
    around = store(around, "near-around")
    open_ = around.groupBy("b").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("b")
    rest = store(around.join(open_, "b", "left_semi").where("a <> b"), "near-open")
    if rest.isEmpty():
        return labels
    posted = _edit_postings(rest, sets, percent)
    first = _linked(store(_edit_stars(posted, may, percent), "near-edit-stars"), orders, sets, m, percent)
    if not first.isEmpty():
        labels = _joined([linked, first])
        posted = posted.drop("label").join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
        posted = store(posted, "near-edit-postings")
    across = store(_edit_pairs(posted, may, percent), "near-across")
    more = _linked(across, orders, sets, m, percent)
    return labels if more.isEmpty() else _joined([linked, first, more])


def _joined(links: list[DataFrame]) -> DataFrame:
    """node, label of the components of all links (a, b)."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("node"), F.col("component").alias("label"))


def _edit_postings(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members ``a`` of a centre in the lists of the elements ``e`` in which they differ from it.

    With each: the member's n, free and label, its number of differences d, and how many of its
    differences that others have too are ``left`` from this one on.
    """
    x, y = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    # The sides are told apart: what the centre lacks, and what it has besides.
    lacks = F.transform(F.array_except("set_b", "set_a"), lambda v: v.bitwiseXOR(F.lit(SEED << 20 | 1)))
    edits = around.join(x, "a").join(y, "b").select("a", "b", "n", "free", "label", "n_b", F.concat(F.array_except("set_a", "set_b"), lacks).alias("edits"))
    edits = store(edits, "near-edits")
    each = edits.select("a", "b", F.explode("edits").alias("e"))
    common = store(each.groupBy("b", "e").count().where("count > 1"), "near-common-edits")
    d, r = F.size("edits"), (100 - percent) / (100 + percent)
    near = d * (100 + percent) <= (F.col("n") + F.col("n_b")) * (100 - percent)
    # What a partner must have in common with it; a little less, for the rounding of doubles.
    least = F.when(near, d * ((1 - r) / 2)).otherwise((d - (F.col("n") + F.col("n_b")) * r) / 2)
    least = F.greatest(F.ceil(least - 1e-6), F.lit(1)).cast("int")
    met = each.join(common, ["b", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("count", "e"))).alias("met"))
    met = met.join(edits.select("a", "b", "n", "free", "label", d.alias("d"), least.alias("least")), ["a", "b"]).where(F.size("met") >= F.col("least"))
    prefix = F.slice("met", F.lit(1), F.size("met") - F.col("least") + F.lit(1))
    place = met.select("a", F.col("b").alias("centre"), "n", "free", "label", "d", F.size("met").alias("len"), F.posexplode(prefix).alias("pos", "p"))
    return store(place.select("a", "centre", "n", "free", "label", "d", F.col("p.e").alias("e"), (F.col("len") - F.col("pos")).alias("left")), "near-edit-postings")


def _may_share(percent: int) -> F.Column:
    """Where two lists first agree, what is left of either must still be as long as the overlap has to be."""
    return F.expr(f"2 * {100 + percent} * least(left, left_b) >= {100 + percent} * (d + d_b) - {100 - percent} * (n + n_b)")


_BESIDE = ("label", "n", "free", "d", "left")


def _edit_stars(posted: DataFrame, may: F.Column, percent: int) -> DataFrame:
    """a, b: the members of a long list of one edit with the one that differs least from the centre."""
    first = F.min(F.struct("d", "a", *[c for c in _BESIDE if c != "d"])).alias("f")
    hubs = posted.groupBy("centre", "e").agg(F.count("*").alias("members"), first).where(F.col("members") >= LONG_LIST)
    hubs = store(hubs.select("centre", "e", F.col("f.a").alias("b"), *[F.col(f"f.{c}").alias(f"{c}_b") for c in _BESIDE]), "near-edit-hubs")
    pairs = posted.join(hubs, ["centre", "e"]).where((F.col("a") != F.col("b")) & (F.col("label") != F.col("label_b")) & may & _may_share(percent))
    return pairs.select("a", "b").distinct().withColumn("met", F.lit(0).cast("long"))


def _edit_pairs(posted: DataFrame, may: F.Column, percent: int) -> DataFrame:
    """a, b: members of one centre and different components, whose differences from it may overlap enough."""
    other = posted.select("centre", "e", F.col("a").alias("b"), *[F.col(c).alias(f"{c}_b") for c in _BESIDE])
    pairs = posted.join(other, ["centre", "e"]).where((F.col("a") > F.col("b")) & (F.col("label") != F.col("label_b")) & may & _may_share(percent))
    return pairs.select("a", "b").distinct().withColumn("met", F.lit(0).cast("long"))


def _met(posted: DataFrame, classes: DataFrame, plain: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node and set, node with its size n and the number ``free`` of its shingles that others have) of posted classes.

    Only classes that share enough to be linked with anything are in the second table.
    """
    used = store(posted.select("node").distinct().join(classes, "node").select("node", "doc", "k1", "k2", "n"), "near-used")
    ids = maybe_broadcast(used.select(F.col("doc").alias("doc_id")))
    read = map_arrow(plain.join(ids, "doc_id", "left_semi").select("text"), _sets(width), "k1 long, k2 long, set array<bigint>")
    read = read.join(maybe_broadcast(used.select("node", "k1", "k2")), ["k1", "k2"]).select("node", "set")
    # A document that repeats with its id is read as often.
    sets = store(read.groupBy("node").agg(F.first("set").alias("set")), "near-sets")
    alone = sets.select("node", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("of"))
    alone = alone.where("of = 1").groupBy("node").agg(F.count("*").alias("alone"))
    facts = used.select("node", "n").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("free"))
    return sets, store(facts.where(f"100 * free >= {percent} * n"), "near-facts")


def _linked(pairs: DataFrame, orders: DataFrame, sets: DataFrame, m: int, percent: int) -> DataFrame:
    """a, b of the pairs (with their collisions ``met`` so far) that are linked.

    Collisions over all lists first, unless the prefixes have enough; then the full sets.
    """
    a, b = (orders.select(F.col("node").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    enough = (F.col("met") >= m) | (F.size(F.array_intersect("tokens_a", "tokens_b")) >= m)
    near = store(pairs.join(a, "a").join(b, "b").where(enough).select("a", "b"), "near-pairs")
    a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = near.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("i"), (F.size("set_a") + F.size("set_b")).alias("n"))
    return store(both.where(f"100L * i >= {percent}L * (n - i)").select("a", "b"), "near-links")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; same columns.

    Rows with a null id and rows without words stay. Rows that repeat with id and text stay or go
    together. An empty table stays empty.
    """
    names = docs.columns
    marks = _marked(docs, width, percent, id_col, text_col)
    gone = marks.groupBy(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).agg(F.max("kept").alias("stays"))
    gone = store(gone.where("not stays and gone_id is not null").select("gone_id", "gone_h"), "near-gone")
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own = (F.col(f"c{names.index(id_col)}") == F.col("gone_id")) & (F.xxhash64(whole_text(F.col(f"c{names.index(text_col)}"))) == F.col("gone_h"))
    return inner.join(maybe_broadcast(gone), own, "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

"""Toxicity scores from subword-bag embeddings, averaged into a linear softmax.

A word is the mean of vectors of its character n-grams and of itself, each found in a table of
hashed buckets, so a misspelling or an inflection never seen shares most vectors with the word it
comes from. A document is an average of its words' vectors, and a linear softmax over that average
tells toxic from clean. The average is weighted: a word counts by the exponential of its own part
in the softmax, so that the few words that matter are not drowned by hundreds that say nothing. It
is still an average: repeating a text changes nothing, and length alone is no evidence. Vectors
and softmax are trained together, in numpy, by Adagrad, through the weights too.

Fitting takes a bounded sample of labelled rows (SAMPLE of each label, of SAMPLE_BYTES a row taken
together; one text may be much longer) to the driver. Since the softmax is linear, what scoring
needs of the model is one number per bucket; that table of a fixed size goes to every task, and
whole texts are scored there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import map_arrow, whole_text
from loomery.llm.words import Memo, blocks, coded

#: Labelled rows of each label, by a hash of the id, and bytes of their texts per row of these
#: numbers, that fitting may use. The bytes bound the sum, not a text.
SAMPLE = {1: 1000, 0: 2000}
SAMPLE_BYTES = 16_384
BUCKET_BITS, DIM = 17, 12
GRAMS = (3, 4, 5)
LEAST_TEXTS = 8
#: Words whose n-grams are hashed at once.
WORDS_AT_ONCE = 8192
#: How much a word's own part in the softmax counts in its weight; 0 would be the plain average,
#: which finds hardly any insult among hundreds of words.
SHARPNESS = 1.0
EPOCHS, BATCH, RATE, START, SEED = 10, 32, 0.3, 3e-4, 7
EDGE = ".,;:!?\"'()[]{}«»“”‘’…"
_FACTORS = (np.random.default_rng(SEED).integers(1 << 31, size=max(GRAMS) + 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).tolist()


def _fold(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, where each word's begin): of the whole word, then of its n-grams with its ends marked."""
    bare = [f"<{w.strip(EDGE)}>" for w in words]
    chars = np.frombuffer("".join(bare).encode("utf-32-le"), "<u4")
    n = np.fromiter(map(len, bare), np.int64, len(bare))
    ends = np.cumsum(n)
    starts = ends - n
    # The whole word: a polynomial over its characters, counted from its start.
    power = np.cumprod(np.full(int(n.max(initial=1)), 16777619, np.uint32), dtype=np.uint32)
    whole = np.add.reduceat(chars * power[np.arange(len(chars)) - np.repeat(starts, n)], starts, dtype=np.uint32)
    owner, found = [np.arange(len(bare))], [_fold(whole)]
    word_of = np.repeat(np.arange(len(bare)), n)
    for g in GRAMS:
        if len(chars) >= g:
            h = np.full(len(chars) - g + 1, _FACTORS[-1] * g & 0xFFFFFFFF, np.uint32)
            for j in range(g):
                h += chars[j : len(chars) - g + 1 + j] * np.uint32(_FACTORS[j])
            inside = word_of[: len(h)] == word_of[g - 1 :]
            owner.append(word_of[: len(h)][inside])
            found.append(_fold(h[inside]))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(bare)))


def _buckets_of_all(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What ``buckets`` gives, a few words at a time: its inner arrays are many times as large as the words."""
    found = [buckets(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    before = np.cumsum([0, *[len(ids) for ids, _ in found[:-1]]])
    return np.concatenate([ids.astype(np.int32) for ids, _ in found]), np.concatenate([begins + b for (_, begins), b in zip(found, before)])


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes and offsets of the texts' words (lower case, white space apart) without empty ones."""
    codes, offsets, words = coded(pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()))))
    real = np.array([bool(w.strip(EDGE)) for w in words], bool)
    if real.all():
        return codes, offsets, words
    keep = real[codes]
    new = np.cumsum(real) - 1
    return new[codes[keep]], np.concatenate([[0], np.cumsum(keep)])[offsets], [w for w, r in zip(words, real) if r]


def _averages(parts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted average of the words' parts per text, minus infinity without words; each word's share)."""
    n = np.diff(offsets)
    out, some = np.full(len(n), -np.inf), np.flatnonzero(n)
    if not len(some):
        return out, np.zeros(0)
    owner = np.repeat(np.arange(len(some)), n[some])
    top = np.maximum.reduceat(parts, offsets[:-1][some])
    share = np.exp(SHARPNESS * (parts - top[owner]))
    share /= np.bincount(owner, share)[owner]
    out[some] = np.bincount(owner, share * parts)
    return out, share


Model = tuple[np.ndarray, float]


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """(part of each bucket, bias): the trained vectors times the difference of the softmax's rows.

    Without texts of either label there is nothing to tell apart, and no model.
    """
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(SEED)
    size = 1 << BUCKET_BITS
    table = rng.normal(0, 1 / DIM, (size, DIM)).astype(np.float32)
    axis, bias = rng.normal(0, 1 / np.sqrt(DIM), DIM).astype(np.float32), -3.0
    # Sums of squared gradients; they start at what one word of a long text typically brings.
    seen_table, seen_axis, seen_bias = np.full(size, START), np.full(DIM, 1e-2), 1.0
    codes, offsets, words = _split(pa.array(texts))
    ids, begins = _buckets_of_all(words)
    sizes, truth = np.diff(np.append(begins, len(ids))), np.array(labels, float)
    # A bucket that few texts of the sample have can only be learnt by heart: it stays at zero.
    told = np.zeros(size, np.int64)
    for i in range(len(texts)):
        used = np.unique(codes[offsets[i] : offsets[i + 1]])
        n = sizes[used]
        told[np.unique(ids[np.repeat(begins[used] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    told = told >= LEAST_TEXTS
    table *= told[:, None]
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            parts = [codes[offsets[i] : offsets[i + 1]] for i in some]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            if not bounds[-1]:
                continue
            used, where = np.unique(np.concatenate(parts), return_inverse=True)
            n = sizes[used]
            inner = np.cumsum(n) - n
            rows = ids[np.repeat(begins[used] - inner, n) + np.arange(n.sum())]
            # A word's part: the mean of its vectors along the difference of the softmax's rows.
            part = (np.add.reduceat((table @ axis)[rows], inner) / n)[where]
            mean, share = _averages(part, bounds)
            per = np.diff(bounds)
            mean[per == 0] = 0
            off = 1 / (1 + np.exp(-np.clip(mean + bias, -40, 40))) - truth[some]
            off[per == 0] = 0
            # The average moves with each part by its share, and by what the share itself moves.
            owner = np.repeat(np.arange(len(per)), per)
            by_word = np.bincount(where, off[owner] * share * (1 + SHARPNESS * (part - mean[owner])), len(used))
            by_bucket = np.bincount(rows, np.repeat(by_word / n, n), size)
            step_axis, step_bias = by_bucket @ table, off.sum()
            by_bucket *= told
            seen_table += by_bucket**2 * float(axis @ axis)
            table -= (RATE * by_bucket / np.sqrt(seen_table)).astype(np.float32)[:, None] * axis
            seen_axis += step_axis**2
            axis -= (RATE * step_axis / np.sqrt(seen_axis)).astype(np.float32)
            seen_bias += step_bias**2
            bias -= RATE * step_bias / np.sqrt(seen_bias)
    return table @ axis, float(bias)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Labelled rows that fitting may see: not held out, bounded in number; ``train`` bounds the bytes.

    A document labelled more than once, or more than once present, counts once, with its largest
    label and its first text.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__label"))
    # The rows are chosen by a hash of their ids; more than asked for, since some have no text.
    known = known.withColumn("__h", F.xxhash64("__id"))
    some = [known.where(F.col("__label") == k).orderBy("__h", "__id").limit(2 * n) for k, n in SAMPLE.items()]
    ids = F.broadcast(some[0].unionByName(some[1]))
    text = docs.select(F.col(id_col).alias("__id"), whole_text(F.col(text_col)).alias("__text"))
    text = text.join(ids, "__id")
    return text.groupBy("__id", "__label", "__h").agg(F.min("__text").alias("__text"))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The model, from at most SAMPLE rows of each label; none without labelled rows of both."""
    rows = sample(docs, labels, id_col, text_col, label_col)
    sizes = rows.select("__id", "__label", F.octet_length("__text").alias("n")).orderBy("__h", "__id").collect()
    chosen = within([(r["__id"], r["__label"], r["n"]) for r in sizes])
    if not chosen:
        return fit([], [])
    of_id = rows.select("__id").schema.add("__at", "long")
    kept = docs.sparkSession.createDataFrame([(i, at) for at, i in enumerate(chosen)], of_id)
    found = rows.join(F.broadcast(kept), "__id").select("__at", "__label", "__text")
    # The sample is bounded, so one task holds it; the driver holds the model alone.
    model = map_arrow(found.repartition(1), _fit_all, "weights binary, bias double").head()
    return (np.frombuffer(bytes(model["weights"]), np.float32), model["bias"]) if model else None


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fit`` of all rows (__at, __label, __text) in the order of the first column; no row without a model."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    model = fit([text for _, _, text in rows], [label for _, label, _ in rows])
    if model:
        weights, bias = model
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def within(sizes: list[tuple]) -> list:
    """Ids of the rows (id, label, bytes) that the sample takes: of each label in order, what fits.

    A text of any length is taken while the label's bytes last; one that is larger than what is
    left gives way to the next.
    """
    out = []
    for k, n in SAMPLE.items():
        count, left = n, n * SAMPLE_BYTES
        for i, label, size in sizes:
            if label == k and count and size <= left:
                out.append(i)
                count, left = count - 1, left - size
    return out


def score(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``carry`` (as c0, c1, ...) and ``__score`` (0 to 1) of every row.

    A text without words scores 0, and without a model all do.
    """
    wanted = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("__text"))
    schema = wanted.drop("__text").schema.add("__score", "double")
    if model is None:
        return wanted.drop("__text").withColumn("__score", F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)
    # A text that is carried along is sent once.
    at = carry.index(text_col) if text_col in carry and dict(docs.dtypes)[text_col] == "string" else len(carry)
    sent = wanted.drop("__text") if at < len(carry) else wanted.withColumn("__text", whole_text(F.col("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value

        def parts(words: list[str]) -> list[float]:
            ids, begins = _buckets_of_all(words)
            n = np.diff(np.append(begins, len(ids)))
            return (np.add.reduceat(weights[ids].astype(float), begins) / n).tolist()

        memo = Memo(parts)
        for b in batches:
            for first, end in blocks(b.column(at)):
                some = b.slice(first, end - first)
                codes, offsets, words = _split(pc.fill_null(some.column(at), ""))
                mean = _averages(np.array(memo(words), float)[codes], offsets)[0]
                p = 1 / (1 + np.exp(-np.clip(mean + bias, -40, 40)))
                p[~np.isfinite(mean)] = 0.0
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(len(carry))], pa.array(p)], [f"c{i}" for i in range(len(carry))] + ["__score"])

    return map_arrow(sent, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Every row: id, held_out, score (0 to 1, higher is likelier toxic) and predicted (score >= 0.5).

    Null texts count as empty. Only the text enters a score. A null id is not held out. Rows are
    scored one by one: repeated rows agree, an empty table gives none. Labels other than 0 and 1
    and labels of documents that are not there are ignored; unless rows of both labels are left to
    learn from, all scores are 0. Other columns are ignored.
    """
    out = score(docs, train(docs, labels, id_col, text_col, label_col), [id_col], text_col)
    p = F.col("__score")
    return out.select(F.col("c0").alias(id_col), held_out(F.col("c0")).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` without rows that are predicted toxic; same columns.

    Null and empty texts stay, repeated rows stay or go together, an empty table stays empty, and
    without labels of both kinds every row stays.
    """
    out = score(docs, train(docs, labels, id_col, text_col, label_col), docs.columns, text_col).where("__score < 0.5")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

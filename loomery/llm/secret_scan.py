"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

One pass over the texts finds the spans of the base patterns and every candidate, a run of 12 or
more characters of the alphabet that keys are written in, with the characters around it. Runs of
letters in one case, a capital in front and stops behind it allowed, are candidates like all others:
most are words, some may be keys. Candidates are few and short against their texts; the table of
them is written once and serves both the fit and the scoring.

The network embeds characters, convolves them with a few filters, takes the maxima over the
candidate and over what stands before and after it, and ends in one logistic unit. It is trained
in numpy on the driver, on a bounded sample of findings. Candidates that a base pattern confirms
are secrets; each is also shown in upper case, in the surroundings of others, and spelled anew with
random letters of both cases and digits and with random letters of one case, for a key is known by
its disorder and not only by the word before it. Clean are the candidates that are seen to be
something else: numbers with separators (addresses, dates), runs of lower-case words and digits
with stops or slashes (hosts, mail, paths), and words: runs of letters in one case that all rows
together show in SEEN different surroundings or more (copies of one text are one). Clean ones are
also shown in upper case, and words too short for a candidate are strung together, so that the
letters of the corpus' words are taught however few of its long words recur. What is none of these
is not taught and only scored. A held-back part of the
sample calibrates the logits (Platt) and sets the threshold, the highest that keeps the asked
recall. Candidates above it that no base span overlaps are added as ``learned`` spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import map_arrow, store, whole_text

# The base patterns, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS, ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 18
HEX, HEX_LEAST = re.compile(r"[0-9a-f]+"), 16

KINDS = ("assign", "access", "hex", "learned")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Runs of letters in one case; they are words where SEEN surroundings or more show them.
WORDLIKE = re.compile(r"[A-Za-z]?(?:[a-z]*|[A-Z]*)[.=_-]*")
#: Runs that are taught as clean: numbers with separators; lower-case words and digits with stops or slashes.
CLEAN = re.compile(r"[0-9]+(?:[./:_+-]+[0-9]+)+[.=-]*|(?=.*[./])(?:[a-z]+[0-9]{0,3}|[0-9]{1,4})(?:[./_-]+(?:[a-z]+[0-9]{0,3}|[0-9]{1,4}))+[./_=-]*")
SEEN = 5
#: Labels of candidates: a base pattern's, of the kind of CLEAN, unknown, letters in one case.
HIT, OTHER, UNKNOWN, LETTERS = 1, 0, -1, -2
AROUND = 24
#: Findings that the fit may use of base patterns, of the kind of CLEAN and of words each, and the longest one.
SAMPLE, SAMPLE_CHARS = 3000, 160
RECALL = 0.97
#: Characters of a row that are convolved at once.
SLICE = 4096
#: Passes over the sample: EPOCHS, and of a small one as many as make STEPS steps.
STEPS = 1500
WIDTH, EMBED, FILTERS, EPOCHS, BATCH, RATE, SEED = 5, 8, 16, 10, 64, 0.01, 5
ALPHABET, LEAST_ANEW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20
ONE_CASE = "abcdefghijklmnopqrstuvwxyz"
#: Words too short for a candidate, in the surroundings of one; so many letters of them are strung together.
SHORT, STRUNG = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z]?[a-z]{1,10}(?![A-Za-z0-9+/_=-])"), (12, 30)
CODES = 100  # 0 nothing, 1 to 95 printable ASCII, 96 white space, 97 letters beyond ASCII, 98 the rest


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap per kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out


def findings(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans in order, candidates as (start, end, label)).

    The label is HIT where a base span overlaps, OTHER where the run is of the kind that CLEAN tells,
    LETTERS where it is letters in one case, and UNKNOWN elsewhere.
    """
    spans, runs = base_spans(text), []
    for m in CANDIDATE.finditer(text):
        runs.append((m.start(), m.end()))
        # A hex run long enough lies inside one run of the wider alphabet.
        spans += [(m.start() + x.start(), 2, m.start() + x.end()) for x in HEX.finditer(m[0]) if x.end() - x.start() >= HEX_LEAST]
    spans.sort()
    out, at = [], 0
    reach = [0]
    for s in spans:
        reach.append(max(reach[-1], s[2]))
    starts = [s[0] for s in spans]
    for a, b in runs:
        while at < len(starts) and starts[at] < b:
            at += 1
        if reach[at] > a:
            out.append((a, b, HIT))
        elif WORDLIKE.fullmatch(text, a, b):
            out.append((a, b, LETTERS))
        else:
            out.append((a, b, OTHER if b - a <= SAMPLE_CHARS and CLEAN.fullmatch(text, a, b) else UNKNOWN))
    return spans, out


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.where((x >= 32) & (x < 127), x - 31, 98)
    out[(x < 33) | (x == 160)] = 96
    out[x > 191] = 97
    return out.astype(np.int64)


class Network:
    """Embedding, one convolution, maxima over left, candidate and right, a logistic unit."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.table = rng.normal(0, 0.3, (CODES, EMBED))
        self.filters = rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS))
        self.shift = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.2, 3 * FILTERS)
        self.bias = np.zeros(1)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 2.0

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, activations) at every position of padded rows of codes."""
        half = WIDTH // 2
        x = self.table[np.pad(codes, ((0, 0), (half, half)))]
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(*codes.shape, WIDTH * EMBED)
        return windows, np.maximum(windows @ self.filters + self.shift, 0)

    def _pool(self, act: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over each of the three parts (0 where it is empty) and where they are."""
        tops, where = [], []
        for k in (1, 2, 3):
            masked = np.where((part == k)[:, :, None], act, -1.0)
            where.append(masked.argmax(1))
            tops.append(np.maximum(masked.max(1), 0))
        return np.concatenate(tops, 1), np.stack(where, 1)

    def logits(self, rows: list[tuple[str, int, int]]) -> np.ndarray:
        """rows: (left + candidate + right, start and end of the candidate); of any length.

        Rows of about one length share a padded block; a long one is read in slices by itself.
        """
        out = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][0]))
        while order and len(rows[order[-1]][0]) > SLICE:
            i = order.pop()
            out[i] = self._sliced(*rows[i]) @ self.out + self.bias[0]
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            codes, part = _padded([rows[i] for i in some])
            step = max(1, (1 << 19) // codes.shape[1])
            for j in range(0, len(some), step):
                pooled = self._pool(self._forward(codes[j : j + step])[1], part[j : j + step])[0]
                out[some[j : j + step]] = pooled @ self.out + self.bias[0]
        return out

    def _sliced(self, text: str, a: int, b: int) -> np.ndarray:
        """What pooling the whole row gives: running maxima over slices, each with its neighbours."""
        half, top = WIDTH // 2, np.zeros((3, FILTERS))
        bounds = ((0, a), (a, b), (b, len(text)))
        for at in range(0, len(text), SLICE):
            end, first = min(at + SLICE, len(text)), max(0, at - half)
            codes = np.zeros(end + half - (at - half), np.int64)
            near = _codes(text[first : end + half])
            codes[first - (at - half) : first - (at - half) + len(near)] = near
            act = self._forward(codes[None])[1][0, half:-half]
            for k, (x, y) in enumerate(bounds):
                part = act[max(0, x - at) : max(0, y - at)]
                if len(part):
                    top[k] = np.maximum(top[k], part.max(0))
        return top.reshape(-1)

    def probability(self, rows: list[tuple[str, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(rows) + self.offset, -40, 40)))

    def train(self, rows: list[tuple[str, int, int]], labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        names = ("table", "filters", "shift", "out", "bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        codes, part = _padded(rows)
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        step = 0
        for _ in range(max(EPOCHS, STEPS * BATCH // max(1, len(rows)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                i = order[at : at + BATCH]
                c, p, step = codes[i], part[i], step + 1
                windows, act = self._forward(c)
                pooled, where = self._pool(act, p)
                guess = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias[0], -40, 40)))
                off = (guess - labels[i]) * weight[i] / len(i)
                grads = {"out": pooled.T @ off, "bias": off.sum(keepdims=True)}
                back = (off[:, None] * self.out * (pooled > 0)).reshape(len(i), 3, FILTERS)
                at_windows = windows[np.arange(len(i))[:, None, None], where]
                grads["filters"] = np.einsum("bkfw,bkf->wf", at_windows, back)
                grads["shift"] = back.sum((0, 1))
                into = np.einsum("bkf,wf->bkfw", back, self.filters).reshape(-1, WIDTH, EMBED)
                padded = np.pad(c, ((0, 0), (WIDTH // 2, WIDTH // 2)))
                chars = padded[np.arange(len(i))[:, None, None, None], where[..., None] + np.arange(WIDTH)].reshape(-1, WIDTH)
                grads["table"] = np.zeros_like(self.table)
                np.add.at(grads["table"], chars.ravel(), into.reshape(-1, EMBED))
                for n, g in grads.items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, getattr(self, n) - RATE * move)

    def calibrate(self, rows: list[tuple[str, int, int]], labels: np.ndarray) -> None:
        """Platt's scaling, then the highest threshold that keeps RECALL of the positives."""
        x = self.logits(rows)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            off, curve = p - labels, np.maximum(p * (1 - p), 1e-9)
            hess = np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-3]])
            move = np.linalg.solve(hess, [(off * x).sum() + 1e-3 * (a - 1), off.sum() + 1e-3 * b])
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        self.scale, self.offset = float(a), float(b)
        found = np.sort(self.probability(rows)[labels == 1])
        self.threshold = max(0.5, float(found[int(np.floor((1 - RECALL) * len(found)))]))


def _padded(rows: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and at each position 1 before the candidate, 2 in it, 3 behind it, 0 in the padding."""
    wide = max((len(r[0]) for r in rows), default=1)
    codes, part = np.zeros((len(rows), wide), np.int64), np.zeros((len(rows), wide), np.int8)
    for i, (text, a, b) in enumerate(rows):
        codes[i, : len(text)] = _codes(text)
        part[i, :a], part[i, a:b], part[i, b : len(text)] = 1, 2, 3
    return codes, part


def fit(rows: list[tuple[str, int, int]], labels: list[int]) -> Network | None:
    """A trained network; None if either label is missing from what trains or calibrates it."""
    y = np.array(labels, float)
    rng = np.random.default_rng(SEED)
    back = rng.random(len(rows)) < 0.25
    if any(y[m].sum() in (0, m.sum()) for m in (back, ~back)):
        return None
    train = [(r, k) for r, k, b in zip(rows, labels, back) if not b]
    held = [(r, k) for r, k, b in zip(rows, labels, back) if b]
    for part in (train, held):
        more = []
        short = sorted({w.lower() for (text, a, b), _ in part for near in (text[:a], text[b:]) for w in SHORT.findall(near)})
        for (text, a, b), k in part:
            # Words are no secrets, nor are they in upper case or strung together.
            spelled = [] if k else [text[a:b].upper()]
            if short:
                least, strung = rng.integers(*STRUNG), ""
                while len(strung) < least:
                    strung += short[rng.integers(len(short))]
                spelled += [strung, strung.upper()]
            for w in spelled:
                other, c, d = part[rng.integers(len(part))][0]
                more.append(((other[:c] + w + other[d:], c, c + len(w)), 0))
            if k:
                other, c, d = part[rng.integers(len(part))][0]
                anew = "".join(rng.choice(list(ALPHABET), max(LEAST_ANEW, b - a)))
                more.append(((text[:a] + text[a:b].upper() + text[b:], a, b), 1))
                more.append(((other[:c] + text[a:b] + other[d:], c, c + b - a), 1))
                more.append(((other[:c] + anew + other[d:], c, c + len(anew)), 1))
                letters = "".join(rng.choice(list(ONE_CASE), max(LEAST_ANEW, b - a)))
                letters = letters.upper() if rng.random() < 0.5 else letters
                more.append(((other[:c] + letters + other[d:], c, c + len(letters)), 1))
        part += more
    net = Network()
    net.train([r for r, _ in train], np.array([k for _, k in train], float))
    net.calibrate([r for r, _ in held], np.array([k for _, k in held], float))
    return net


SPAN = "array<struct<start: bigint, kind: int, stop: bigint>>"
FOUND = "array<struct<start: bigint, stop: bigint, hit: int, near: string, before: int>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
    found = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("hit", pa.int32()), ("near", pa.string()), ("before", pa.int32())])
    for b in batches:
        spans, runs = [], []
        for text in b.column(1):
            t = text.as_py()
            base, near = findings(t)
            spans.append([{"start": s, "kind": k, "stop": e} for s, k, e in base])
            runs.append([{"start": s, "stop": e, "hit": h, "near": t[max(0, s - AROUND) : e + AROUND], "before": min(s, AROUND)} for s, e, h in near])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span)), pa.array(runs, pa.list_(found))], ["doc_id", "base", "found"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: id, n_assign, n_access, n_hex (spans of each base pattern), base and spans.

    ``base`` and ``spans`` are strings of kind:start:end in code points, end exclusive, in the
    order of start and then of KINDS, joined by commas; ``spans`` also has the learned ones. Null
    texts count as empty. Rows are scanned one by one, so repeated rows agree; a null id stays
    null; an empty table gives no rows. Where the sample has no finding of one label, nothing is
    learned and nothing added. Other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    table = store(map_arrow(plain, _find, f"doc_id long, base {SPAN}, found {FOUND}"), "secret-findings")
    each = table.select(F.explode("found").alias("f")).select("f.*", (F.col("f.stop") - F.col("f.start")).alias("n"))
    each = each.where(F.col("n") <= SAMPLE_CHARS).select("hit", "near", "before", "n", F.xxhash64("near", "before").alias("h"))
    sample = []
    # Equal findings count once: a copied document is no further evidence.
    once = each.distinct()
    for k in (HIT, OTHER):
        sample += once.where(F.col("hit") == k).orderBy("h", "near", "before").limit(SAMPLE).collect()
    one = once.where(F.col("hit") == LETTERS).withColumn("run", F.expr("substring(near, before + 1, cast(n as int))"))
    words = one.groupBy("run").agg(F.count("*").alias("seen"), F.min(F.struct("h", "near", "before", "n")).alias("f")).where(F.col("seen") >= SEEN)
    sample += words.select(F.lit(OTHER).alias("hit"), "f.*").orderBy("h", "near", "before").limit(SAMPLE).collect()
    net = fit([(r["near"], r["before"], r["before"] + r["n"]) for r in sample], [r["hit"] for r in sample])
    held = docs.sparkSession.sparkContext.broadcast(net)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            base = [[(s["start"], s["kind"], s["stop"]) for s in x] for x in b.column(1).to_pylist()]
            runs = b.column(2).to_pylist()
            flat = [(i, f) for i, x in enumerate(runs) for f in x]
            p = model.probability([(f["near"], f["before"], f["before"] + f["stop"] - f["start"]) for _, f in flat]) if model and flat else []
            more: dict[int, list[tuple[int, int, int]]] = {}
            for (i, f), x in zip(flat, p):
                if x >= model.threshold and f["hit"] != HIT:
                    more.setdefault(i, []).append((f["start"], 3, f["stop"]))
            count = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(3)]
            text = [_spelled(x) for x in base], [_spelled(sorted(x + more.get(i, []))) for i, x in enumerate(base)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *count, pa.array(text[0], pa.string()), pa.array(text[1], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    out = map_arrow(table, join, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
    return out.withColumnRenamed("doc_id", id_col)


def _spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

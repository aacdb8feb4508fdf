"""Personal data, filter audits and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import log

import pytest

from loomery.llm import collocations, filter_audit, personal_data, queries

# The patterns as they are asked for, to hold the operator's own forms against.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def _plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(_digits(m[0])) <= 19 and _luhn(_digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15]
    return out


def test_base_spans_of_random_strings():
    rng = random.Random(3)
    pieces = ["1", "25", "256", ".", "@", "a", "b-c", "+", " ", "-", "(", ")", "4111111111111111", "4111 1111-1111 1111", "é", "\n", "x@y.z", "1.2.3.4", "+49 30 123", "0001"]
    found = Counter()
    for _ in range(30_000):
        t = "".join(rng.choices(pieces, k=rng.randrange(1, 24)))
        want = _plain_spans(t)
        assert [(personal_data.BASE[k], a, b) for k, a, b in personal_data.base_spans(t)] == want, t
        found.update(k for k, _, _ in want)
    assert min(found[k] for k in personal_data.BASE) > 500


@pytest.mark.parametrize("unit", ["1", "1.", "1 ", "+1 ", "+1(", "a", "a@", "a.", "@a.", "1-"])
def test_base_spans_of_long_runs_take_linear_time(unit):
    import time

    start = time.time()
    personal_data.base_spans(unit * (400_000 // len(unit)))
    assert time.time() - start < 5


def _people():
    """Texts: Zorblatt stands near one address in many surroundings, Quux mostly; the rest is noise."""
    rng = random.Random(5)
    noise = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choices(noise, k=n))
    texts = [some(30) for _ in range(200)]
    for i in range(8):
        texts.append(f"{some(9)} Zorblatt, {some(2)} <zq@mail.example> {some(5)}\n{some(40)}")
    texts += [f"{some(8)} Quux {some(3)} +1 (555) 010-2222 {some(6)} {some(40)}" for _ in range(6)] + [f"{some(20)} quux. {some(30)}" for _ in range(2)]
    # One text many times: Copycat stands near the address in these alone.
    texts += [f"{noise[0]} Copycat {noise[1]} cc@mail.example {noise[2]}"] * 20
    texts += [f"{some(30)} ZORBLATT! {some(3)}", None, "", "zq@mail.example"]
    return texts


def _plain_disclosing(texts):
    texts = [t or "" for t in texts]
    own, both, marks = Counter(), Counter(), defaultdict(list)
    for t in texts:
        spans = personal_data.base_spans(t)
        met = defaultdict(list)
        for kind, a, b in spans:
            key = (kind, t[a:b].lower() if kind < 2 else _digits(t[a:b]))
            met[key, ""] += []
            near = {}
            for m in WORD.finditer(t):
                x, y = m.span()
                inside = (a - personal_data.AROUND <= x and y <= a) or (b <= x and y <= b + personal_data.AROUND)
                if inside and not any(x < q and p < y for _, p, q in spans) and personal_data.term_of(m[0]):
                    w = personal_data.term_of(m[0])
                    near[w] = personal_data._hash(w) >> 1
            for w in near:
                rest = [h for v, h in near.items() if v != w] or [0]
                met[key, w].append((min(rest), max(rest)))
        for (key, w), m in met.items():
            (both if w else own)[(key, w) if w else key] += 1
            marks[key, w] += m
    seen = Counter(w for t in texts for w in {personal_data.term_of(x) for x in WORD.findall(t)})
    best = {}
    for (key, w), n in both.items():
        if n < personal_data.SUPPORT or len({a for a, _ in marks[key, w]}) < 2 or len({b for _, b in marks[key, w]}) < 2:
            continue
        s = log(n * len(texts) / (own[key] * seen[w])) / log(len(texts) / own[key])
        if s >= personal_data.GENERALISE:
            best[w] = max(s, best.get(w, 0))
    return best


def test_terms_that_disclose(spark):
    texts = _people()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _plain_disclosing(texts)
    got = {r.term: (r.strength, r.action) for r in personal_data.disclosing_terms(docs).collect()}
    assert {t: round(s, 9) for t, (s, _) in got.items()} == {t: round(s, 9) for t, s in want.items()}
    assert "zorblatt" in want and "quux" in want and "copycat" not in want
    assert all(a == ("remove" if s >= personal_data.REMOVE else "generalise") for s, a in got.values())
    terms = spark.createDataFrame([(t, s, a) for t, (s, a) in got.items()], "term string, strength double, action string")
    rows = {r.doc_id: r for r in personal_data.find_personal(docs, terms=terms).collect()}
    for i, t in enumerate(texts):
        spans = _plain_spans(t or "")
        added = []
        for m in WORD.finditer(t or ""):
            core = m[0].strip("<>,.!()+")
            a = m.start() + m[0].index(core)
            if core.lower() in got and not any(p < a + len(core) and a < q for _, p, q in spans):
                added.append((got[core.lower()][1], a, a + len(core)))
        assert rows[i].base == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans + sorted(added))
    clean = {r.doc_id: r.text for r in personal_data.sanitised(docs, terms=terms).collect()}
    assert len(clean) == len(texts) and clean[len(texts) - 3] is None
    assert not any("orblatt" in (t or "").lower() or "zq@" in (t or "") for t in clean.values())
    assert clean[0] == texts[0]


def test_personal_data_of_odd_rows(odd, odd_rows, empty):
    got = personal_data.find_personal(odd).collect()
    assert sorted((r.doc_id or 0, r.base) for r in got) == sorted((i or 0, ",".join(f"{k}:{a}:{b}" for k, a, b in _plain_spans(t or ""))) for i, t, _ in odd_rows)
    assert personal_data.find_personal(empty).count() == 0
    assert personal_data.sanitised(odd).schema == odd.schema
    assert sorted(map(repr, (r.text for r in personal_data.sanitised(odd).collect()))) == sorted(repr(t) for _, t, _ in odd_rows)


def test_op11(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = _plain_spans(texts[r.doc_id])
        own = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest() and r.spans.startswith(own)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in spans) for n in personal_data.BASE)


def _plain_audit(docs, labels):
    """One filter after the other, removing rows."""
    told = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        told[i] = [told[i][0] or quality == 1, told[i][1] or toxic == 1]
    ids = defaultdict(list)
    for i, t, _ in docs:
        ids[t or ""].append(i)
    rows = defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        others = [x for x in ids[t] if x is not None]
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": bool(others) and (i is None or min(others) < i),
        }
        rows[part or ""].append((fails, *told[i]))
    out, share = {}, Counter()
    for part, own in rows.items():
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                failing = [r for r in own if r[0][f]]
                alone = sum(sum(r[0].values()) == 1 for r in failing)
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone))
                share[part, f] += len(gone)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def test_filter_audit_of_odd_rows(spark, odd, odd_rows, empty):
    rng = random.Random(9)
    texts = ["a b", "A B C", "x" * 30, "AAAA bb cc", "$ 1", " ".join(map(str, range(120))), "w " * 150, "W# " * 120, None, ""]
    rows = [(i if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(400)]
    rows += rows[:20]
    labels = [(rng.randrange(400), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = _audited(filter_audit.filter_audit(docs, told))
    assert len(got) == 3 * 600 and got == _plain_audit(rows, labels)
    assert _audited(filter_audit.filter_audit(odd, told)) == _plain_audit([(i, t, "en") for i, t, _ in odd_rows], labels)
    assert filter_audit.filter_audit(empty, told).count() == 0
    assert _audited(filter_audit.filter_audit(docs, told.where("false"))) == _plain_audit(rows, [])


def test_op12(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert _audited(queries.op12_filter_audit(spark, sf_dir)) == _plain_audit(docs, labels)


def _plain_collocations(docs, least=10, covered=50, top=2000):
    counts, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, t in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(lower)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    rows = defaultdict(list)
    for (lang, w), a in counts.items():
        if len(w) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        rows[lang].append((w, a, min(cuts)))
    out = []
    for lang, own in rows.items():
        longer = Counter()
        for w, a, _ in own:
            for inner in ((w[:2], w[1:]) if len(w) == 3 else ()):
                longer[inner] = max(longer[inner], a)
        left = [(w, a, c) for w, a, c in own if 100 * longer[w] < covered * a]
        left.sort(key=lambda x: (-x[2][0], -x[1], " ".join(x[0]).encode()))
        out += [(lang, i, " ".join(w), a, c[2], c[3], n[lang], c[0]) for i, (w, a, c) in enumerate(left[:top], 1)]
    return sorted(out)


def _rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_collocations_of_odd_rows(spark, odd, odd_rows, empty, monkeypatch):
    rng = random.Random(2)
    words = ["a", "B", "bb", "ß", "日本", "x-y", "\x1c", "'", "c" * 300, "a b", "tt"]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "?!"]
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(120)))) for _ in range(300)]
    docs += [("en", None), (None, ""), ("en", " \t"), ("zz", "one two")] + [("fr", "a a a a a a")] * 9
    df = spark.createDataFrame(docs, "lang string, text string")
    want = _plain_collocations(docs)
    assert want and _rows(collocations.collocations(df)) == want
    assert _rows(collocations.collocations(df, top=7)) == _plain_collocations(docs, top=7)
    assert _rows(collocations.collocations(odd, least=2)) == _plain_collocations([("en", t) for _, t, _ in odd_rows], least=2)
    assert collocations.collocations(empty).count() == 0


@pytest.mark.parametrize("shard", [1, 2, 7, 50])
def test_shards_count_what_begins_in_them(monkeypatch, shard):
    rng = random.Random(shard)
    monkeypatch.setattr(collocations, "SHARD", shard)
    texts = [" ".join(rng.choices(["a", "b", "aa", ".", "ab"], k=60)) for _ in range(4)] + ["", "."]
    stream = collocations.Stream(texts, "en", collocations._word_memo())
    starts = [stream.real, stream.real[:-1] & stream.real[1:], stream.real[:-2] & stream.real[1:-1] & stream.real[2:]]
    got = Counter()
    for first in range(0, len(stream.codes), shard):
        phrases, n, _ = collocations._count_shard(stream, first, starts, [stream.buckets(length, 6) for length in (2, 3)])
        got.update(dict(zip(phrases.to_pylist(), n.tolist())))
    want = Counter()
    for t in texts:
        for piece in t.split("."):
            w = piece.split()
            for k in (2, 3):
                want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert +got == want


def test_sketch_lets_every_frequent_phrase_pass(spark, sf_dir):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert _rows(queries.op13_collocations(spark, sf_dir)) == _plain_collocations(docs)


def test_bits_of_spark_and_numpy_agree(spark):
    import numpy as np

    terms = [f"t{i}é" for i in range(500)]
    held = personal_data._map_of(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert personal_data.holds(held, personal_data._buckets(terms)).all()
    assert int(sum(bin(int(w)).count("1") for w in held[held > 0])) == len(np.unique(personal_data._buckets(terms)))


def test_counts_come_back_whole_from_their_lists():
    import numpy as np
    import pyarrow as pa

    rng, counted, want = random.Random(5), collocations.Counted(), Counter()
    for _ in range(30):
        own = Counter(rng.choices(["", "é", "a b", "a", "a b c", "ß ü"], k=9))
        phrases, n = list(own), list(own.values())
        counted.add("en", pa.array(phrases, pa.large_string()), np.array(n), np.array([len(p) % 3 for p in phrases]))
        want.update(own)
    assert counted.held > len(want)
    rows = [(r["part"], collocations._unpacked(r["packed"]).to_pylist()) for b in counted.sent() for r in b.to_pylist()]
    assert {r["phrase"]: r["a"] for _, part in rows for r in part} == want
    assert len({p for p, _ in rows}) == len(rows) and all(len(r["phrase"]) % 3 == p for p, part in rows for r in part)
    assert not list(counted.sent())

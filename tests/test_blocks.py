"""Blocks, sentences, stems, neighbours and nests against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomery.functions.stem import stem
from loomery.operators.nearest_rows import beside, outermost
from loomery.plans import blocks
from loomery.plans.prose import segment_count


def test_segments_of_names(spark):
    want = {"scan_row_cap": 3, "PyProject": 2, "HTTPServer": 2, "RULES": 1, "Level": 1, "_2abc_defg": 2}
    df = spark.createDataFrame([(n,) for n in want], "name string")
    assert {r.name: r.n for r in df.select("name", segment_count(F.col("name")).alias("n")).collect()} == want


def test_sentences(spark):
    text = "See a.toml first; then call b.rs. 再见了。Really? yes! end"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "v1.2 is out"), (5, "One...\n\nTwo;;")], "id long, text string")
    got = {}
    for r in blocks.split_sentences(rows, "text").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.sentence)
    assert got == {1: ["See a.toml first;", "then call b.rs.", "再见了。", "Really?", "yes!", "end"], 4: ["v1.2 is out"], 5: ["One...", "Two;;"]}


def test_kinds_of_lines(spark):
    text = "one\n# Head\ntwo\n| a | b |\n-\n- item\n<!-- x -->\n===\n```rust\n# code\n\n```\nafter\n~~~\nopen\nstill"
    rows = [(1, text), (2, None), (3, "")]
    got = [(r.doc_id, r.kind) for r in blocks.kinds_of_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "k").collect()]
    kinds = "prose heading prose table bare prose comment underline fenced fenced fenced fenced prose fenced fenced fenced".split()
    assert got == [(1, k) for k in kinds] + [(2, "blank"), (3, "blank")]


# Examples that the paper gives for its steps, with what all steps together make of them.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, want):
    assert stem(word) == want


def test_other_words_stay():
    assert [stem(w) for w in ("is", "Cats", "été", "a1s", "")] == ["is", "Cats", "été", "a1s", ""]


def test_stems_of_a_table(spark):
    bag = spark.createDataFrame([("cats", 1), ("cat", 2), ("cats", 3), (None, 4)], "word string, id long").where("word is not null")
    assert sorted((r.id, r.stem) for r in blocks.stemmed(bag).collect()) == [(1, "cat"), (2, "cat"), (3, "cat")]


@pytest.mark.parametrize("width", [3, 7, 64])
def test_neighbours(spark, width):
    rng = random.Random(width)
    # One key has most of the rows.
    keyed = lambda n, base: [(rng.choice(["hot"] * 6 + ["x", "y"]), rng.randint(-90, 90), base + i) for i in range(n)]
    asked, units = keyed(150, 0), keyed(60, 1000)
    schema = "key string, at long, id long"
    odd = [(None, 1, 900), ("hot", None, 901)]
    got = {r.id: (r.before_id, r.after_id) for r in beside(spark.createDataFrame(asked + odd, schema), spark.createDataFrame(units + odd, schema), "key", 2, 3, width).collect()}
    for key, at, i in asked:
        low = [(-a, u) for k, a, u in units if k == key and at - 2 <= a <= at]
        high = [(a, u) for k, a, u in units if k == key and at < a <= at + 3]
        assert got[i] == (min(low)[1] if low else None, min(high)[1] if high else None), (key, at, i)
    assert got[900] == got[901] == (None, None)
    with pytest.raises(ValueError):
        beside(spark.createDataFrame(asked, schema), spark.createDataFrame(units, schema), "key", 65, 3, 64)


def test_outermost(spark):
    rng = random.Random(2)
    spans = [(rng.choice("aab"), s, s + rng.randint(0, 30)) for s in (rng.randint(-50, 120) for _ in range(300))] + [("n", 0, 1000)] + [("n", i, 999 - i) for i in range(400)]
    rows = [(k, a, b, i) for i, (k, a, b) in enumerate(spans)]
    got = {r.id for r in outermost(spark.createDataFrame(rows, "key string, first long, last long, id long"), "key", 16).collect()}
    want = {i for k, a, b, i in rows if not any(x == k and p <= a and q >= b and (p, q) != (a, b) for x, p, q, _ in rows)}
    assert got == want


def test_stem_counts_send_sums_only(spark):
    texts = ["Cats cat, running", "run runs cats", None, "", "ponies Cats cats 42"]
    n, df, spelled = Counter(), Counter(), {}
    for t in texts:
        own = re.findall(r"\w+", (t or "").lower())
        n.update(map(stem, own))
        df.update({stem(w) for w in own})
        for w in own:
            spelled.setdefault(stem(w), set()).add(w)
    got = blocks.stem_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.stem: (r.n, r.df, r.n_words) for r in got.collect()} == {s: (n[s], df[s], len(spelled[s])) for s in n}


def test_stem_statistics_shuffle_no_texts(spark, sf_dir):
    plan = blocks.stem_statistics(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(stem#" in plan and "doc_id" not in plan

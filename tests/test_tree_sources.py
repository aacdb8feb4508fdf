"""Sources of pairs of page trees against plain versions."""

import random
from collections import Counter
from itertools import combinations

import xxhash

from loomery.plans import tree_sources as plans
from loomery.plans import trees


def _html(tags):
    return "<html>" + "".join(f"<{t}></{t}>" for t in tags) + "</html>"


def _units(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return trees.units(trees.nodes(pages)), pages


def _pairs(df):
    rows = [(r.a, r.b) for r in df.collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows)
    return set(rows)


def _runs(tags, n):
    return {tuple(tags[i : i + n]) for i in range(len(tags) - n + 1)}


def _fnv(data):
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 % 2**64
    return h


def _bands(tags):
    """Bands of four of the 128 least hashes of (element, index), one value at a time."""
    elements = [xxhash.xxh64_intdigest(" ".join(r), 42).to_bytes(8, "little") for r in _runs(tags, plans.SHINGLE)]
    least = [min(_fnv(e + i.to_bytes(4, "little")) for e in elements) for i in range(128)]
    return {(i // 4, *least[i : i + 4]) for i in range(0, 128, 4)}


def test_sources_and_verdicts_of_random_trees(spark):
    rng, bodies = random.Random(5), {}
    for i in range(40):
        if i % 4:
            body = list(bodies[i - 1])
            for _ in range(rng.randint(1, 6)):
                body[rng.randrange(len(body))] = rng.choice("abipqs")
            body = body[: rng.randint(24, len(body))]
        else:
            body = [rng.choice("abipqs") for _ in range(rng.randint(24, 50))]
        bodies[i] = body
    name = {i: f"http://h.example.com/d/n{i % 13}" + rng.choice(["", "/", ".html", "?p=1", "#top", ".html#x/y"]) for i in bodies}
    rows = [(i, name[i], _html(b)) for i, b in bodies.items()]
    # A copy, a page without address, too small a page, one without tags, and null.
    rows += [(50, None, _html(bodies[0])), (51, "http://h.example.com", _html(bodies[1])), (52, name[0], "<html><p></p></html>"), (53, name[0], ""), (54, name[0], None)]
    unit, pages = _units(spark, rows)
    tags = {}
    for i, b in bodies.items():
        if ["html", *b] not in tags.values():
            tags[i] = ["html", *b]
    both = list(combinations(sorted(tags), 2))
    assert _pairs(plans.run_pairs(unit)) == {(a, b) for a, b in both if _runs(tags[a], plans.RUN) & _runs(tags[b], plans.RUN)}
    assert _pairs(plans.name_pairs(unit, pages)) == {(a, b) for a, b in both if a % 13 == b % 13}
    near, bands = _pairs(plans.band_pairs(unit)), {i: _bands(t) for i, t in tags.items()}
    assert near == {(a, b) for a, b in both if bands[a] & bands[b]} and 0 < len(near) < len(both)
    got = {(r.a, r.b): r for r in plans.sourced(unit, pages).collect()}
    for (a, b), r in got.items():
        common = sum((Counter(tags[a]) & Counter(tags[b])).values())
        small, large = sorted((len(tags[a]), len(tags[b])))
        assert (r.n_a, r.n_b, r.common) == (len(tags[a]), len(tags[b]), common)
        assert r.verdict == ("size" if small * 100 < large * 85 else "labels" if common * 100 < large * 85 else "judged")
        assert bool(r.sources & 16) == (r.verdict == "judged") and bool(r.sources & 8) == ((a, b) in near)
    assert {r.verdict for r in got.values()} == {"size", "labels", "judged"}
    for bit, part in ((1, plans.run_pairs(unit)), (2, plans.name_pairs(unit, pages)), (4, plans.fingerprint_pairs(unit))):
        assert {p for p, r in got.items() if r.sources & bit} == _pairs(part)


def test_a_hot_name_is_a_chain(spark):
    rng = random.Random(2)
    rows = [(i, "http://h.example.com/index.html", _html([rng.choice("abip") for _ in range(30)])) for i in range(90)]
    rows += [(200 + i, "http://h.example.com/other", _html([rng.choice("abip") for _ in range(30)])) for i in range(3)]
    unit, pages = _units(spark, rows)
    assert _pairs(plans.name_pairs(unit, pages)) == {(i, i + 1) for i in range(89)} | {(200, 201), (200, 202), (201, 202)}


def test_no_pages(spark):
    unit, pages = _units(spark, [])
    assert plans.sourced(unit, pages).collect() == []

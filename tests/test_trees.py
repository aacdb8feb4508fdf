"""Trees, cuts and clusters against plain versions."""

import random
import time
from functools import lru_cache
from itertools import permutations

import numpy as np
import pytest

from loomery.operators import arcs, clusters, graph, trees
from loomery.plans import trees as plans


def _random_tree(rng, n, labels="abc"):
    depths = [0]
    while len(depths) < n:
        depths.append(rng.randint(1, depths[-1] + 1))
    return [rng.choice(labels) for _ in depths], depths


def _nested(labels, depths):
    def build(i):
        kids, j = [], i + 1
        while j < len(depths) and depths[j] > depths[i]:
            if depths[j] == depths[i] + 1:
                kids.append(build(j))
            j += 1
        return (labels[i], tuple(kids))

    return build(0)


@lru_cache(maxsize=None)
def _plain(a, b):
    """Edit distance of two forests by the definition: take away the last root, or match it."""
    if not a and not b:
        return 0
    best = 10**9
    if a:
        best = min(best, _plain(a[:-1] + a[-1][1], b) + 1)
    if b:
        best = min(best, _plain(a, b[:-1] + b[-1][1]) + 1)
    if a and b:
        best = min(best, _plain(a[-1][1], b[-1][1]) + _plain(a[:-1], b[:-1]) + (a[-1][0] != b[-1][0]))
    return best


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(150):
        a, b = (_random_tree(rng, rng.randint(1, 9)) for _ in range(2))
        (la, fa), (lb, fb) = ((np.array(x)[trees.post_order(d)[0]], trees.post_order(d)[1]) for x, d in (a, b))
        assert trees.distance(la, fa, lb, fb) == _plain((_nested(*a),), (_nested(*b),)), (a, b)


def _html(tree):
    label, kids = tree
    return f"<{label}>" + "".join(map(_html, kids)) + f"</{label}>"


def test_clones_of_random_pages(spark):
    rng = random.Random(8)
    pages = []
    for i in range(30):
        if i % 5:
            labels, depths = list(pages[i - 1][0]), list(pages[i - 1][1])
            for _ in range(rng.randint(0, 4)):
                labels[rng.randrange(len(labels))] = rng.choice("abcd")
        else:
            labels, depths = _random_tree(rng, rng.randint(22, 34), "abcd")
        pages.append((labels, depths))
    rows = [(i, _html(_nested(*p))) for i, p in enumerate(pages)] + [(90, None), (91, ""), (92, "<a></a><b></b>" * 20), (93, "no tags")]
    unit = plans.units(plans.nodes(spark.createDataFrame(rows, "page_id long, html string")))
    kinds = {r.page_id: r for r in unit.collect()}
    assert kinds[92].kind == "forest" and not {90, 91, 93} & set(kinds)
    first = {}
    for i, p in enumerate(pages):
        first.setdefault((tuple(p[0]), tuple(p[1])), i)
        assert kinds[i].kind == ("tree" if len(p[0]) >= plans.LEAST_NODES else "small")
        assert kinds[i]["class"] == first[tuple(p[0]), tuple(p[1])]
    reps = [i for i in sorted(first.values()) if kinds[i].kind == "tree"]
    want = set()
    for x in reps:
        for y in reps:
            if x < y:
                (a, fa), (b, fb) = ((np.array(pages[k][0])[trees.post_order(pages[k][1])[0]], trees.post_order(pages[k][1])[1]) for k in (x, y))
                d, large = trees.distance(a, fa, b, fb), max(len(a), len(b))
                if (large - d) * 100 >= 85 * large:
                    want.add((x, y, d))
    assert want and {(r.a, r.b, r.ted) for r in plans.clones(unit).collect()} == want


def test_holes_of_a_large_group(spark):
    page = lambda i: "<html><title>{0}</title><h1>{0}</h1>".format(f"t{i}") + f"<p>same</p><p>x{i % 2}</p>" + "<i></i>" * 20 + "</html>"
    rows = [(i, page(i)) for i in range(100)] + [(200, "<html>" + "<b></b>" * 30 + "</html>")]
    node = plans.nodes(spark.createDataFrame(rows, "page_id long, html string"))
    group = plans.groups(plans.units(node))
    assert {(r.group, r.members) for r in group.collect()} == {(0, 100)} and group.count() == 100
    got = {r.pos: (r.fixed, r.value, r.param) for r in plans.generalised(node, group).collect()}
    assert got[1] == (False, None, 1) and got[2] == (False, None, 1) and got[4] == (False, None, 4)
    assert got[3] == (True, "p same", None) and all(got[k][0] for k in range(5, 25))


def _weight(order, edges):
    at = {v: i for i, v in enumerate(order)}
    return sum(w for a, b, w in edges if at[a] > at[b])


def _cyclic(edges):
    left = {(a, b) for a, b in edges}
    while left:
        sources = {a for a, _ in left} - {b for _, b in left}
        if not sources:
            return True
        left = {(a, b) for a, b in left if a not in sources}
    return False


def test_cuts_of_small_components_weigh_least(spark):
    rng = random.Random(6)
    edges, best = [], 0
    for c in range(5):
        names = [f"{c}-{i}" for i in range(6)]
        own = [(a, b, rng.randint(1, 9)) for a in names for b in names if a != b and rng.random() < 0.45]
        edges += own
        best += min(_weight(p, own) for p in permutations(names))
    edges += [("0-0", "1-0", 5), ("1-0", "2-0", 5), ("x", "x", 3)]
    cuts = arcs.feedback_arcs(spark.createDataFrame(edges, "src string, dst string, w long")).collect()
    assert sum(r.w for r in cuts) == best and all(r.exact for r in cuts)
    assert not _cyclic({(a, b) for a, b, _ in edges if a != b} - {(r.src, r.dst) for r in cuts})


def test_cuts_of_a_large_component(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(400)} | {(i, (i + 1) % 60) for i in range(60)}
    edges = [(a, b, rng.randint(1, 5)) for a, b in sorted(edges) if a != b]
    df = spark.createDataFrame(edges, "src long, dst long, w long")
    cuts = arcs.feedback_arcs(df).collect()
    left = {(a, b) for a, b, _ in edges} - {(r.src, r.dst) for r in cuts}
    assert cuts and not any(r.exact for r in cuts) and not _cyclic(left)
    assert 2 * sum(r.w for r in cuts) <= sum(w for _, _, w in edges)
    level = {r.id: r.level for r in graph.levels(spark.createDataFrame(sorted(left), "src long, dst long")).collect()}
    assert all(level[a] > level[b] for a, b in left)


def test_levels_of_a_cycle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.levels(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long"))


def _modularity(edges, cluster):
    m = sum(w for *_, w in edges)
    k = {}
    for a, b, w in edges:
        for v in (a, b):
            k[cluster[v]] = k.get(cluster[v], 0) + w
    return sum(w for a, b, w in edges if cluster[a] == cluster[b]) / m - sum(x * x for x in k.values()) / (4 * m * m)


def test_planted_clusters_are_found(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(a, b, 1) for a in range(32) for b in range(a) if rng.random() < (0.8 if a // 8 == b // 8 else 0.03)]
    seen, moved = [], clusters._moved

    def watched(*args):
        out = moved(*args)
        if out[0].count() == 32:
            seen.append(_modularity(edges, {r.id: r.cluster for r in out[0].collect()}))
        return out

    monkeypatch.setattr(clusters, "_moved", watched)
    got = {r.id: r.cluster for r in clusters.clusters(spark.createDataFrame(edges, "src long, dst long, w long")).collect()}
    assert got == {i: i // 8 * 8 for i in range(32)}
    assert seen == sorted(seen)


def test_near_distance_is_the_distance_or_more_than_asked():
    rng = random.Random(9)
    seen = set()
    for _ in range(300):
        a, b = (_random_tree(rng, rng.randint(1, 14)) for _ in range(2))
        if rng.random() < 0.5:
            b = (list(a[0]), list(a[1]))
            for _ in range(rng.randint(0, 3)):
                b[0][rng.randrange(len(b[0]))] = rng.choice("abc")
        full = []
        for labels, depths in (a, b):
            order, first = trees.post_order(depths)
            full.append((np.array(labels), np.array(labels)[order], first))
        true = trees.distance(*full[0][1:], *full[1][1:])
        for most in (0, 1, 2, 4, 30):
            got = trees.near_distance(*full, most)
            assert got == (true if true <= most else None)
            seen.add(got is None)
    assert seen == {True, False}


def test_few_pairs_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(plans, "PAIRS", 2)
    form = lambda i: ",".join(f"{t} {d}" for t, d in [("a", 0), *[("b", 1)] * 30, (f"c{i}", 1)])
    unit = spark.createDataFrame([(i, 32, "tree", i, form(i)) for i in range(7)], "page_id long, n long, kind string, class long, form string")
    found = plans.clones(unit)
    assert {(r.a, r.b, r.ted) for r in found.collect()} == {(a, b, 1) for b in range(7) for a in range(b)}
    assert found.rdd.getNumPartitions() > 5


def _read(labels, depths):
    order, first = trees.post_order(depths)
    return np.array(labels), np.array(labels)[order], first


def _edited(rng, labels, depths):
    """The tree with one node changed, taken out or put in between a node and some of its neighbouring children."""
    labels, depths = list(labels), list(depths)
    i = rng.randrange(len(labels))
    end = next((j for j in range(i + 1, len(depths)) if depths[j] <= depths[i]), len(depths))
    what = rng.randrange(3)
    if what == 0:
        labels[i] = rng.choice("abc")
    elif what == 1 and i:
        depths[i:end] = [d - 1 for d in depths[i + 1 : end]]
        del labels[i]
    elif what == 2:
        kids = [j for j in range(i + 1, end) if depths[j] == depths[i] + 1] + [end]
        x, y = sorted(rng.choice(kids) for _ in range(2))
        depths[x:y] = [depths[i] + 1, *(d + 1 for d in depths[x:y])]
        labels.insert(x, rng.choice("abc"))
    return labels, depths


def test_near_distance_of_edited_trees():
    rng = random.Random(12)
    seen = set()
    for _ in range(200):
        a = b = _random_tree(rng, rng.randint(1, 30), rng.choice(["a", "ab", "abcde"]))
        edits = rng.randint(0, 8)
        for _ in range(edits):
            b = _edited(rng, *b)
        x, y = _read(*a), _read(*b)
        true = trees.distance(*x[1:], *y[1:])
        assert true <= edits
        for most in (0, 1, 3, 6, 60):
            assert trees.near_distance(x, y, most) == (true if true <= most else None), (a, b, most)
        seen.add(true)
    assert len(seen) > 5


def test_near_distance_of_large_pages_is_not_slow():
    # Links, and paragraphs that a tag without an end takes in: tables of all their subtrees took 19 s.
    page = [("html", 0), ("ul", 1), *[("li", 2), ("a", 3)] * 60, ("div", 1)]
    for k in range(60):
        page += [("p", 2 + k), *[("p", 3 + k), ("i", 4 + k)] * 4, ("b", 2 + k)]
    labels, depths = map(list, zip(*page))
    changed = range(10, len(page), 16)
    other = [labels[i] if i not in changed else "x" for i in range(len(page))]
    # Besides, a node between the root and all else, and a leaf less.
    other, below = ["html", "y", *other[1:]], [0, 1, *(d + 1 for d in depths[1:])]
    del other[4], below[4]
    began = time.process_time()
    assert trees.near_distance(_read(labels, depths), _read(other, below), 100) == len(changed) + 2
    assert time.process_time() - began < 8


def test_near_distance_of_trees_deeper_than_the_stack():
    n = 2000
    labels, depths = ["ab"[i % 2] for i in range(n)], list(range(n))
    other = list(labels)
    other[n // 2] = other[n - 1] = "c"
    assert trees.near_distance(_read(labels, depths), _read(other, depths), 10) == 2
    # Each node has a leaf on either side of the next one.
    zigzag = [(label, d + k) for d in range(n // 2) for label, k in (("s", 0), ("l", 1))] + [("r", d) for d in range(n // 2, 0, -1)]
    labels, depths = map(list, zip(*zigzag))
    other = list(labels)
    for i in (4, 501, n // 2 - 1, len(other) - 9):
        other[i] = "c"
    assert trees.near_distance(_read(labels, depths), _read(other, depths), 10) == 4

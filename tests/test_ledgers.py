"""Ledgers of added lines, anchors of elements, credit for moves, one suggestion a set."""

import random
from collections import Counter

from loomery.plans.ledgers import chain_anchors, credit, ledger, suggestions


def _plain(turns):
    """Line by line: the last version's lines are matched with what was added last."""
    out = {}
    for conv in {c for c, _, _ in turns}:
        for speaker in (0, 1):
            own = sorted((t, Counter(x.strip() for x in (text or "").split("\n") if any(map(str.isalnum, x)))) for c, t, text in turns if c == conv and t % 2 == speaker)
            versions = dict(own)
            rows, stands = {}, Counter(own[-1][1]) if own else Counter()
            for t, now in reversed(own):
                was = versions.get(t - 2, Counter())
                added, removed = now - was, was - now
                kept = Counter({b: min(n, stands[b]) for b, n in added.items()})
                stands -= kept
                a, r = sum(added.values()), sum(removed.values())
                rows[t] = (a, a - min(a, r), min(a, r), sum(kept.values()), a - sum(kept.values()))
                if added or removed or now:
                    out[conv, t] = rows[t]
                elif was:
                    out[conv, t] = rows[t]
    return out


def test_ledger_balances_and_equals_a_plain_one(spark):
    rng = random.Random(3)
    turns = [(c, t, "\n".join(rng.choices(["a", "b", " a ", "c", "--", "d e", ""], k=rng.randrange(6)))) for c in range(12) for t in range(rng.randrange(1, 9))]
    turns += [(90, 0, None), (91, 0, ""), (91, 2, "x\nx"), (91, 4, "x"), (91, 6, None), (92, 0, "k"), (92, 4, "k")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    got = {(r[0], r[1]): tuple(r)[2:] for r in ledger(df).collect()}
    assert got == _plain(turns)
    assert all(a == ap + rw == s + ch for a, ap, rw, s, ch in got.values())
    assert got[91, 2] == (2, 2, 0, 0, 2), "an empty side before rewrites nothing"
    assert ledger(df.limit(0)).count() == 0


def test_anchors_follow_containers():
    tags, depths = ["html", "div", "p", "p", "ul", "li", "p"], [0, 1, 2, 2, 1, 2, 3]
    a = chain_anchors(tags, depths)
    assert a == ["html#0", "html>div#0", "html>div>p#0", "html>div>p#1", "html>ul#0", "html>ul>li#0", "html>ul>li>p#0"]
    # Without the first container, what stands in the other one keeps its anchors.
    assert chain_anchors(["html", "ul", "li", "p"], [0, 1, 2, 3]) == [a[0], *a[4:]]
    assert chain_anchors([], []) == [] and chain_anchors(["a", "b"], [0, -1]) == ["a#0", "b#0"]


def test_moves_are_credited_and_copies_are_not(spark):
    held = [("a", 1, "r"), ("b", 1, "r"), ("b", 2, "r"), ("c", 2, "r")]  # a to c, b stays: moved
    held += [("a", 1, "s"), ("a", 2, "s"), ("d", 2, "s")]  # a second copy
    held += [("a", 1, "t"), ("e", 2, "t"), ("f", 2, "t")]  # two copies for one
    held += [("g", 2, "u")]  # new everywhere
    got = {tuple(r)[:2]: tuple(r)[2:] for r in credit(spark.createDataFrame(held, "file string, step int, run string")).collect()}
    assert got == {("c", 2): (1, 1, True), ("d", 2): (1, 0, False), ("e", 2): (1, 0, False), ("f", 2): (1, 0, False)}


def test_one_suggestion_for_one_set(spark):
    member = [(0, "x", 1), (0, "x", 2), (1, "y", 2), (1, "y", 1), (1, "z", 1), (1, "z", 3), (0, "w", 9)]
    got = sorted(tuple(r) for r in suggestions(spark.createDataFrame(member, "family int, key string, id long")).collect())
    assert got == [(0, 1, 2), (1, 1, 2)]

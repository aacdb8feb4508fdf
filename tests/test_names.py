"""Patterns, hashes and diffs against plain versions."""

import re
from itertools import combinations

import numpy as np
import pytest

from loomery.functions import fnv
from loomery.functions.globs import glob_regex
from loomery.plans.overlaps import buckets, signed
from loomery.plans.prose import common_lines, line_diffs


def _fits(glob, path):
    """Pieces of a pattern against a path, by trying."""
    if not glob:
        return not path
    if glob.startswith("**/"):
        return _fits(glob[3:], path) or any(c == "/" and i and _fits(glob, path[i + 1 :]) for i, c in enumerate(path[: path.find("/") + 1]))
    if glob.startswith("**"):
        return any(_fits(glob[2:], path[i:]) for i in range(len(path) + 1))
    if glob[0] == "*":
        end = path.find("/") if "/" in path else len(path)
        return any(_fits(glob[1:], path[i:]) for i in range(end + 1))
    if glob[0] == "?":
        return bool(path) and path[0] != "/" and _fits(glob[1:], path[1:])
    if glob[0] == "[":
        inner, rest = glob[1:].split("]", 1)
        return bool(path) and (path[0] in inner.lstrip("!")) != inner.startswith("!") and _fits(rest, path[1:])
    return bool(path) and path[0] == glob[0] and _fits(glob[1:], path[1:])


def _fits_path(glob, path):
    if glob.endswith("/"):
        glob += "**"
    if "/" in glob:
        return _fits(glob, path)
    return _fits(glob, path) or any(c == "/" and _fits(glob, path[i + 1 :]) for i, c in enumerate(path))


def test_patterns_of_random_pieces():
    rng = np.random.default_rng(12)
    pieces, letters = ["p", "q", "/", "*", "?", "**/", "[pq]", "[!p]", "."], list("ppqq//.")
    hits = 0
    for _ in range(4000):
        glob = "".join(rng.choice(pieces, rng.integers(1, 6)))
        if "//" in glob or glob.startswith("/") or "***" in glob:
            continue
        # A class outside brackets may take a slash in one reading: paths for it have none.
        path = "".join(rng.choice(letters if "[!" not in glob else list("ppqq."), rng.integers(1, 7)))
        if "//" in path or path[0] == "/" or path[-1] == "/":
            continue
        hit = bool(re.match(glob_regex(glob), path))
        assert hit == _fits_path(glob, path), (glob, path)
        hits += hit
    assert hits > 100


@pytest.mark.parametrize("glob,path,hit", [("docs/{api,guide}/*.html", "docs/api/index.html", True), ("docs/{api,guide}/*.html", "docs/blog/index.html", False), ("v1,v2.txt", "old/v1,v2.txt", True)])
def test_patterns_with_braces(glob, path, hit):
    assert bool(re.match(glob_regex(glob), path)) == hit


@pytest.mark.parametrize("glob", ["!a", "#a", "a\\b", "", "{a,b"])
def test_patterns_that_are_refused(glob):
    with pytest.raises(ValueError):
        glob_regex(glob)


def _fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def test_signatures_and_band_keys():
    assert _fnv(b"a") == 0xAF63DC4C8601EC8C
    x = [3, -7, 1 << 60]
    want = [min(_fnv(v.to_bytes(8, "little", signed=True) + i.to_bytes(4, "little")) for v in x) for i in range(128)]
    got = fnv.signature(np.array(x))
    assert got.tolist() == want
    keys = fnv.band_keys(np.stack([got]))[0]
    assert keys.tolist() == [_fnv(b"".join(v.to_bytes(8, "little") for v in want[i : i + 4])) for i in range(0, 128, 4)]
    assert set(fnv.signature(np.array([], "int64")).tolist()) == {(1 << 64) - 1}


def test_equal_sets_share_all_bands(spark):
    rows = [(i, s) for i in (1, 2) for s in "abc"] + [(3, "z")]
    out = buckets(signed(spark.createDataFrame(rows, "id long, s string"))).collect()
    assert len(out) == 32 and {(r["n"], r["first"]) for r in out} == {(2, 1)}


def _plain(a, b):
    for n in range(min(len(a), len(b)), 0, -1):
        if {tuple(a[i] for i in c) for c in combinations(range(len(a)), n)} & {tuple(b[i] for i in c) for c in combinations(range(len(b)), n)}:
            return n
    return 0


def test_line_diff(spark):
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.choice(list("xyz"), rng.integers(0, 7)).tolist() for _ in range(2))
        assert common_lines(a, b) == _plain(a, b)
    side = [(1, 0, "before", i, c) for i, c in enumerate("abc")] + [(1, 0, "after", i, c) for i, c in enumerate("axcd")] + [(2, 0, "after", 0, "q")]
    out = line_diffs(spark.createDataFrame(side, "conv_id long, pair long, side string, pos long, body string"))
    assert {tuple(r) for r in out.collect()} == {(1, 0, 1, 2, False), (2, 0, 0, 1, False)}

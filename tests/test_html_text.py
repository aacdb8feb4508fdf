"""Text of block elements, claims in comments, blocks that move."""

from collections import Counter

import pytest

from loomery.plans.html_text import block_classes, segments, tokens


@pytest.fixture
def cut(spark):
    def run(*html):
        rows = segments(tokens(spark.createDataFrame(list(enumerate(html)), "page_id int, html string"))).collect()
        return sorted((r["page_id"], r["seg"], r["tag"], r["first"], r["last"], r["words"], r["allowed"], r["without_why"]) for r in rows)

    return run


def _said(rows):
    return [(r[2], r[3], r[4], r[5]) for r in rows]


def test_an_element_says_its_own_words_over_its_rows(cut):
    html = '<div id="x y">\n<p>red &lt; <i>green</i>\n blue\n</p><ul>\n<li>outer <p>inner</p> again</li></ul><pre>no\ncode</pre>\n<script>var no;</script>tail <code>no</code> end</div>'
    assert _said(cut(html)) == [("div", 1, 7, "tail end"), ("p", 2, 3, "red green blue"), ("li", 5, 5, "outer again"), ("p", 5, 5, "inner")]


def test_cells_of_one_row_are_segments_of_their_own(cut):
    assert _said(cut("<table><tr><td>one two</td><td>three</td></tr></table>")) == [("td", 1, 1, "one two"), ("td", 1, 1, "three")]


def test_a_paragraph_ends_where_the_next_block_begins(cut):
    assert _said(cut("<div><p>one<p>two<div>three</div>four</div>")) == [("div", 1, 1, "four"), ("p", 1, 1, "one"), ("p", 1, 1, "two"), ("div", 1, 1, "three")]


def test_odd_pages(cut):
    assert cut(None, "", "<p></p>", "<!-- words -->", "<style>words</style>", "< >") == []
    assert _said(cut("bare words", "</div></div>lost <p>held", "a < b <b>c")) == [("", 1, 1, "bare words"), ("", 1, 1, "lost"), ("p", 1, 1, "held"), ("", 1, 1, "a b c")]
    assert cut("<p>" + "long " * 50_000)[0][5].count("long") == 50_000


def test_a_claim_exempts_its_own_element_and_must_say_why(cut):
    html = "<!-- allow(duplicate) -- above --><p>one <!-- allow(duplicate) -- kept in step with the index --></p><p>two <!-- allow(duplicate) --></p><p>three<!-- allow(duplicate) --  --></p><p>four</p>"
    assert [(r[5], r[6], r[7]) for r in cut(html)] == [("one", True, 0), ("two", False, 1), ("three", False, 1), ("four", False, 0)]


def test_blocks_that_go_and_come(spark):
    held = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "x"), ("b", 3, "z"), ("c", 1, "z"), ("c", 2, "x")]
    got = {r["said"]: tuple(r)[1:] for r in block_classes(spark.createDataFrame(held, "host string, step long, said string")).collect()}
    # x leaves a at 2 and b at 3, and comes with b at 2 and c at 2; y leaves b and comes with a; z leaves c and comes with b.
    assert got == {"x": (2, 2, "a", 2, "b", 2), "y": (1, 1, "b", 2, "a", 2), "z": (1, 1, "c", 2, "b", 3)}
    assert Counter(len(v) for v in got.values()) == {6: 3}

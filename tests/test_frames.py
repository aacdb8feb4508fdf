"""Names bound by words that say they are gone."""

import pytest

from loomery.plans.frames import bound_names


@pytest.fixture
def bound(spark):
    def run(*texts):
        rows = bound_names(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
        return sorted((r["doc_id"], r["frame"], r["name"], r["in_brackets"]) for r in rows)

    return run


def _names(rows):
    return [(r[2], r[3]) for r in rows]


def test_words_behind_a_frame(bound):
    assert _names(bound("Soup (no Green Onion) today")) == [("green", True), ("green_onion", True)]
    assert _names(bound("bake_without_sugar")) == [("sugar", False)] == _names(bound("no more sugar"))
    assert _names(bound("no", "nothing here", "no. sugar", "no (sugar)", "[no]")) == []
    assert _names(bound("without a b c d")) == [("a", False), ("a_b", False), ("a_b_c", False)]


def test_words_before_a_frame(bound):
    assert _names(bound("sugar free drinks")) == [("sugar", False)]
    assert _names(bound("the old oven removed")) == [("old_oven", False), ("oven", False), ("the_old_oven", False)]
    assert _names(bound("removed", "(oven) removed", "freedom")) == []


def test_frames_are_no_names(bound):
    assert bound("no sugar removed") == [(0, "no", "sugar", False), (0, "removed", "sugar", False)]


def test_frames_inside_a_run(bound):
    assert bound("汤（无糖）", "糖已移除", "无sugar", "sugar已移除", "无", "已移除") == [
        (0, "无", "糖", True), (1, "已移除", "糖", False), (2, "无", "sugar", False), (3, "已移除", "sugar", False),
    ]


def test_odd_texts(bound):
    assert bound(None, "", "))) no", "no") == []
    assert _names(bound(")(no salt")) == [("salt", False)]
    assert len(bound("no salt. " * 20_000)) == 20_000

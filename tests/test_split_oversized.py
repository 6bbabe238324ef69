"""Pieces rebuild their text and keep to the limits."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.functions.tokens import TOKEN
from granary.operators.split_oversized import split_oversized, split_text

WORDS = st.lists(st.sampled_from(["a", "bc", "Don't", "x_1", "é", "数据", "end.", "fin!", ",", "\n", "\n\n", "\r\n", "# H\n", "def f():\n", "  ", "ह", "—", "𝒳"]), max_size=400)


@settings(max_examples=60, deadline=None)
@given(WORDS, st.integers(8, 40), st.integers(0, 7))
def test_pieces_rebuild_the_text(parts, limit, overlap):
    text = " ".join(parts)
    ps = split_text(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end, _, _ in ps) == text
    for start, own, end, tokens, shared in ps:
        assert tokens == len(TOKEN.findall(text[start:end])) <= limit
        assert shared == len(TOKEN.findall(text[start:own])) <= overlap


def test_cuts_at_natural_boundaries():
    para = " ".join(["word"] * 30) + "."
    text = "\n\n".join([para] * 6)
    for start, own, end, *_ in split_text(text, 70, 5)[1:]:
        assert text[own - 2 : own] == "\n\n"


def test_operator(spark):
    long = "\n".join(f"line {i} of text, with words." for i in range(400))
    df = spark.createDataFrame([(1, long, 9), (1, long, 9), (2, "short", 9), (3, None, 9), (4, " ", 9)], "id long, content string, piece int")
    got = split_oversized(df, "id", "content").collect()
    assert {r.key for r in got} == {1} and max(r.tokens for r in got) <= 512
    assert len(got) == 2 * len(split_text(long))
    assert split_oversized(df.limit(0), "id", "content").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "content", 10, 10)


def test_one_giant_line():
    ps = split_text("x" + " y" * 5000, 512, 64)
    assert len(ps) >= 10 and all(p[3] <= 512 for p in ps)

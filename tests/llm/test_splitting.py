import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.llm import splitting as S


def coarsest(text, limit):
    """By definition: every single unit of the whole text fits without its outer white space."""
    cuts = [r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+", r"\r\n|\n|\r", r"(?<=[.!?])\s+|(?<=[。！？])|\r\n|\n|\r", r"\s+"]
    return next((u for u, cut in zip(S.UNITS, cuts, strict=False) if all(len(x.strip()) <= limit for x in re.split(cut, text))), "char")


def boundary(text, limit):
    return S.pieces(text, limit, 0)[1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r#-。é1<liu/>", max_size=400), st.integers(4, 60), st.data())
def test_round_trip(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    parts, unit = S.pieces(text, limit, overlap)
    assert unit == coarsest(text, limit)
    assert "".join(text[s:e] for _, s, e in parts) == text
    for (a, s, e), before in zip(parts, [None, *parts], strict=False):
        assert e - a <= limit and s - a <= overlap and (before is None or before[2] == s)


def test_boundaries():
    p, n = "x" * 30, "\n"
    assert boundary(f"{p}\n \n{p}", 40) == "paragraph"
    assert boundary(f"{p}\n{p}", 40) == "line" and boundary(f"{p}\r\n{p}", 40) == "line"
    assert boundary(f"{p}. {p}", 40) == "sentence" and boundary(f"{p}。{p}", 40) == "sentence"
    assert boundary(f"{p} {p}", 40) == "word" and boundary(p + p, 40) == "char"
    assert boundary(f"  {p}  {n}", 30) == "paragraph"


def test_units_that_fit_are_not_cut():
    text = "# A\n\n" + "a" * 30 + "\n\n# B\n\n" + "b" * 38 + "\n\n" + "c" * 10
    parts = [text[s:e].strip() for _, s, e in S.pieces(text, 40, 10)[0]]
    assert "a" * 30 in parts[0] and any(x.endswith("b" * 38) or x == "b" * 38 for x in parts)
    heads = "# One\nxx\n# Two\nyy\n# Three\n" + "z" * 35
    assert [text[:5] for text in (heads[s:e] for _, s, e in S.pieces(heads, 45, 5)[0])][0] == "# One"


def test_operator(spark):
    df = spark.createDataFrame([("a", "w " * 2000, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4), ("e", " " * 3000, 5)], "key string, text string, piece_no long")
    got = S.split_oversized(df, F.col("key"), F.col("text"))
    rows = got.collect()
    assert {r["id"] for r in rows} == {"a", "e"} and all(len(r["piece"]) <= 2400 for r in rows)
    a = sorted((r for r in rows if r["id"] == "a"), key=lambda r: r["piece_no"])
    assert "".join(r["piece"][r["n_overlap"] :] for r in a) == "w " * 2000 and a[1]["n_overlap"] > 150
    assert S.split_oversized(df.limit(0), F.col("key"), F.col("text")).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(df, F.col("key"), F.col("text"), 10, 10)


def test_sections_lists_and_elements_stay_whole():
    def cut(text, limit):
        return [text[s:e].strip() for _, s, e in S.pieces(text, limit, 0)[0]]

    items = [f"- item {k}\n  - {'x' * 14}\n  - {'y' * 14}\n" for k in range(4)]
    assert cut("".join(items), 50) == [x.strip() for x in items]
    assert cut("Some words first\n" + "".join(items), 50) == ["Some words first", *[x.strip() for x in items]]
    rows = [f"<ul>\n<li>{'a' * 12}</li>\n<li>{'b' * 12}</li>\n</ul>\n" for _ in range(3)]
    assert cut("".join(rows), 60) == [x.strip() for x in rows]
    text = "# One\n\n" + "a" * 20 + "\n\n## Two\n\n" + "b" * 20 + "\n\n# Three\n\n" + "c" * 20
    assert cut(text, 64) == [text[: text.index("# Three")].strip(), text[text.index("# Three") :]]
    assert cut(text, 40)[:2] == ["# One\n\n" + "a" * 20, "## Two\n\n" + "b" * 20]


def test_tree():
    def shape(node):
        return [shape(c) for c in node.children] or (node.start, node.end)

    text = "a\n\n# H\n\nb\n\n- i\n\n- j\n\nc"
    assert shape(S.parse(text)) == [(0, 3), [(3, 8), (8, 11), [(11, 16)], [(16, 21)], (21, 22)]]
    assert S.parse("").children[0].end == 0
    S.pieces("<div>\n" * 5000 + "x", 100, 10)
    S.pieces("".join(" " * (k % 900) + "- x\n" for k in range(5000)), 2400, 200)

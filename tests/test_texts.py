import pytest
from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.functions import text as T
from quarrylight.operators import chunking as K


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_cleaning(spark):
    assert one(spark, T.clean_text, "x\n\n\ny  z", " a\u00a0b\x1fc ", "", None) == ["x y z", "a b c", "", None]
    assert one(spark, T.normalize_newlines, " a\n\n \n b\n") == ["a\nb"]
    assert one(spark, lambda c: T.clean_text(c, whitespace=False), "a\n\n\n\nb") == ["a\n\nb"]
    assert one(spark, T.clean_markdown, "a ```x\ny``` b `c` d") == ["a  b c d"]
    assert one(spark, T.as_string, None, "a") == ["", "a"]
    assert one(spark, T.content_type, "<p>x</p>", "# Title", "- item", "plain", None) == ["html", "markdown", "markdown", "text", None]


def test_tokens(spark):
    assert one(spark, T.count_tokens, "a b  c", "", None) == [3, 0, 0]
    assert one(spark, lambda c: T.count_tokens(c, "char"), "abcdefghi", None) == [2, 0]
    assert one(spark, T.tokens, "Hello, wörld!") == [["Hello", ",", "wörld", "!"]]
    assert one(spark, T.sentences, "One. Two?\nThree") == [["One.", "Two?", "Three"]]
    assert one(spark, lambda c: T.contains_word(c, "po"), "a po.", "pot") == [True, False]


def test_markdown_parts(spark):
    assert one(spark, T.front_matter, "---\ntitle: A: b\nname: c\n---\nbody", "none") == [{"title": "A: b", "name": "c"}, None]
    assert one(spark, T.first_heading, "x\n# A\r\n# B") == ["A\r"]
    assert one(spark, lambda c: T.field_line(c, "author"), "Title: x\nAuthor: Test User\n") == ["Test User"]
    assert [tuple(x) for x in one(spark, T.markdown_links, "[a](b) ![i](p.png)")[0]] == [("a", "b"), ("i", "p.png")]


def test_html(spark):
    page = "<html><head><title>Test</title><meta name=\"a\" content=\"b\"></head><body><h1>Hi</h1><script>alert(1)</script><!-- x --><p>a &amp; <b>b</b></p><a href='u'>l</a><img src=\"i.png\"></body></html>"
    assert one(spark, H.html_text, page) == ["Test Hi a & b l"]
    assert one(spark, H.title, page) == ["Test"] and one(spark, lambda c: H.title(c, "none"), "x") == ["none"]
    assert one(spark, H.images, page) == [["i.png"]] and one(spark, H.meta, page) == [{"a": "b"}]
    assert [tuple(x) for x in one(spark, H.links, page)[0]] == [("u", "l")]
    assert one(spark, H.slug, "https://a.b/c/d/?q", "https://a.b", None) == ["c_d", "index", None]
    assert one(spark, H.clean_fragment, "<p style='x'>a</p>")[0].endswith("<p>a</p>")


def chunks(df):
    return [r["chunk"] for r in df.orderBy("chunk_index").collect()]


def test_chunks(spark):
    df = spark.createDataFrame([("a b c d e", 1)], "text string, token_count long")
    got = K.word_chunks(df, size=3, overlap=1)
    assert chunks(got) == ["a b c", "c d e", "e"] and got.columns.count("token_count") == 1
    assert K.word_chunks(spark.createDataFrame([("",), (" \n",), (None,)], "text string")).count() == 0
    with pytest.raises(ValueError):
        K.word_chunks(df, size=3, overlap=3)
    md = spark.createDataFrame([("intro\n# A\nbody\n## sub\n# B\n",)], "text string")
    assert chunks(K.chunk(md, "header")) == ["intro", "# A", "body\n## sub", "# B"]
    assert chunks(K.token_windows(df, size=3, overlap=1)) == ["a b c", "c d e"]
    assert chunks(K.token_windows(df, size=9, overlap=1)) == ["a b c d e"]
    with pytest.raises(ValueError):
        K.chunk(df, "other")


def test_sections_of_html(spark):
    df = spark.createDataFrame([("<p>x</p>\n<h2 class='a'>One</h2><p>y</p><figure><img></figure> z<H1>Two</H1>", "keep"), (None, "k"), ("  ", "k")], "content string, heading string")
    got = [(r["chunk_type"], r["heading"], r["chunk"].strip()) for r in K.html_sections(df).orderBy("chunk_index").collect()]
    assert got == [("lead", None, "<p>x</p>"), ("section", "One", "<h2 class='a'>One</h2><p>y</p>"), ("figure", None, "<figure><img></figure>"), ("lead", None, "z"), ("section", "Two", "<H1>Two</H1>")]


def test_entities_of_any_name(spark):
    assert one(spark, H.html_text, "<p>&euro; &#8364; &#x20AC; &lt;b&gt; &amp;lt; &nope; &eacute;t&eacute;</p>")[0] == "€ € € <b> &lt; &nope; été"
    assert one(spark, H.html_strings, "<p>a &#60;i&#62;</p> <p>b</p>")[0] == "a <i> b"

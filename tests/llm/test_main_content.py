import random
import re

from pyspark.sql import functions as F

from quarrylight.llm import main_content as M


def page(i, rng):
    body = ["<p>Paragraph " + " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8)) + ".</p>" for _ in range(6)]
    lines = ["<html><head><title>Page %d | Site</title></head><body>" % i, "<ul>", "<li><a href='/a'>Home</a></li>", "<li><a href='/b'>Prices</a></li>", "</ul>"]
    lines += [f"<h1>Page {i}</h1>", *body[:3], "<div>Was this of use? Yes No</div>" if i % 3 else "", *body[3:], "<p>Read next</p>", "<p><a href='/x'>Fixed tale one</a></p>", "<p><a href='/y'>Fixed tale two</a></p>", "<p>© 2020 Site. All rights reserved.</p>", "</body></html>"]
    want = [n for n, x in enumerate(lines, 1) if x.startswith(("<h1>", "<p>Paragraph"))]
    return "\n".join(lines), want


def test_wrapper_of_a_site(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for i in range(20):
        text, lines = page(i, rng)
        rows.append((i, f"HTTPS://www.Site.example/p/{i}", f"Page {i}", text, "x"))
        want |= {(i, n) for n in lines}
    rows += [(90, "https://site.example/e", "E", "", "x"), (91, None, None, None, "x"), (92, None, None, "plain text\nmore of it.", "x"), (93, "https://alone.example/", "Alone", "<p>Alone</p>\n<p>One sentence here.</p>", "x")]
    df = spark.createDataFrame([*rows, rows[0]], "id long, link string, title string, content string, host string")
    got = {tuple(r) for r in M.main_content(df, F.col("id"), F.col("link"), F.col("title"), F.col("content")).collect()}
    assert {x for x in got if x[0] < 90} == want
    assert {x for x in got if x[0] >= 90} == {(92, 1), (92, 2), (93, 1), (93, 2)}
    assert M.main_content(df.limit(0), F.col("id"), F.col("link"), F.col("title"), F.col("content")).count() == 0


def leaf(key, n=1):
    return M.Node(key=key, n=n)


def box(tag, *kids, cls="", n=1):
    return M.Node(tag, cls, 0, n, -1, list(kids))


def test_tree_matching():
    a = box("r", leaf(1), box("div", leaf(2), leaf(3)), leaf(4))
    b = box("r", box("div", leaf(3)), leaf(4), leaf(1))
    weight, pairs = M.align(a, b)
    assert weight == 4 and [(x.key, y.key) for x, y in pairs if x.key] == [(4, 4), (3, 3)] or sorted(x.key for x, _ in pairs if x.key) == [3, 4]
    best = M.align(box("r", *[leaf(k) for k in (1, 2, 3, 4, 5)]), box("r", *[leaf(k) for k in (1, 3, 9, 4, 2, 5)]))
    assert sorted(x.key for x, _ in best[1] if x.key) == [1, 3, 4, 5]
    one, two = box("div", leaf(5), cls="menu"), box("div", leaf(6), cls="body")
    assert [(x.cls, y.cls) for x, y in M.align(box("r", one, two), box("r", box("div", cls="body")))[1]][1:] == [("body", "body")]


def test_merged_wrappers_count_pages():
    wrapper = box("r", leaf(1), leaf(2))
    M.merge(wrapper, box("r", leaf(1), leaf(7), box("div", leaf(8)), leaf(2)))
    M.merge(wrapper, M._loads(M._dumps(box("r", leaf(7, 3), box("div", leaf(8, 3), n=3), n=3))))
    assert [(k.key, k.n) for k in wrapper.kids] == [(1, 2), (7, 4), (0, 4), (2, 2)] and wrapper.n == 5
    assert [k.key for k in M.kept(wrapper, 4).kids] == [7, 0]


def test_hosts_and_broken_markup():
    assert [M.host_of(x) for x in ("HTTP://WWW.A.example:80/x", " a.example/", "https://u@b.example?q", None, "")] == ["a.example", "a.example", "b.example", "", ""]
    _, lines, title = M.parse("<html><head><title>T</title></head>\n<p>a <b>b</p></div>\n<script>\nvar x = 1;\n</script>\n&copy; c")
    assert title == "T" and [(x.no, x.text) for x in lines] == [(2, "a b"), (6, "© c")]
    holders, lines, _ = M.parse("<div>\n" * 3000 + "x\n" + "</div>\n" * 3000)
    assert lines[0].no == 3001 and len(holders) == 3001 and len(M._needed(holders, lines)[0]) == 2
    small, number = M._needed(*M.parse("".join(f"<div>\nline {k}\n" for k in range(2000)))[:2])
    deep = M.tree(small, [(k + 1, k, k) for k in range(1, 2000)])
    assert M.align(deep, M._loads(M._dumps(deep)))[0] > 1999
    holders, lines, _ = M.parse("<ul>\n<li>one</li>\n<li>two\n</ul>\nthree <td>four</td> five")
    assert [(holders[x.holder][1], x.text) for x in lines] == [("ul", "one"), ("ul", "two"), ("page", "three four five")]


def test_keys_leave_out_what_differs_between_sites():
    def key(text, brand=""):
        return M.masked(text, re.compile(brand) if brand else None)

    assert key("We at Acme Works use a.example and 12 cookies", "Acme Works") == key("We at Bolt use c.d.example and 345 cookies", "Bolt")
    _, lines, _ = M.parse("Home > Blog > My Tale\nMy Tale\nA | B c | D | E\n| 1 | 2 | 3 | 4 |", None)
    assert [x.title for x in lines] == [False, True, False, False] and lines[0].key == M._h("\x03trail") and lines[2].key == M._h("\x03bar") != lines[3].key


def test_a_list_of_the_template_is_known_by_its_slot(spark):
    """Lists whose lines differ from page to page go with their slot; the same lines within the article stay."""
    rng = random.Random(5)

    def title():
        return "Tale of " + "".join(rng.choice("abcdefghij") for _ in range(6))

    rows, want = [], set()
    for i in range(30):
        body = [f"Words {title()} and more of it.", title(), title(), f"Last {title()} ends here."]
        lines = ["Home", "Shop", f"Page {i}", *body, "See also", title(), title(), "All rights kept"]
        rows.append((i, "https://flat.example/x", f"Page {i}", "\n".join(lines)))
        want |= {(i, n) for n in range(3, 8)}
    df = spark.createDataFrame(rows, "id long, link string, title string, content string")
    got = {tuple(r) for r in M.main_content(df, F.col("id"), F.col("link"), F.col("title"), F.col("content")).collect()}
    assert got == want


def test_large_hosts_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 4)
    rng = random.Random(1)
    pages = [page(i, rng) for i in range(40)]
    df = spark.createDataFrame([(i, "https://site.example/p", f"Page {i}", text) for i, (text, _) in enumerate(pages)], "id long, link string, title string, content string")
    parsed = df.mapInArrow(M._parsed, M._PARSED)
    found = M.wrappers(parsed).collect()
    whole = M._loads(found[0]["wrapper"])
    home = M._h("Home")
    assert len(found) == 1 and whole.n == 40 and dict(M._keys_of(whole))[home] == 40
    got = {tuple(r) for r in M.main_content(df, F.col("id"), F.col("link"), F.col("title"), F.col("content")).collect()}
    assert got == {(i, n) for i, (_, lines) in enumerate(pages) for n in lines}


"""The main body of pages, by wrapper induction.

Each page becomes a small tree: the containers that span several lines, and the lines with visible text as leaves. The trees
of a host are aligned by simple tree matching and merged into one wrapper, group by group and then round by round, every
node counting the pages it was aligned with. A page is then aligned with the wrapper of its host: leaves that recur are
template; what varies stands in slots, between one recurring leaf of a container and the next. A slot or container whose
varying lines never hold prose, over all pages of the host, is a list of the template; all other slots are content.

Leaves that few pages of any one host show (notices, sign-up lines) are counted over all hosts; these phrases also stand in
for the wrapper where a host has a single page.
"""

from __future__ import annotations

import html
import json
import re
import sys
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import spread
from quarrylight.operators.skew import split_join
from quarrylight.scratch import write_out

#: Pages of a host are aligned in groups of about so many; so many partial wrappers are merged at a time.
GROUP, MERGED = 48, 48
#: A leaf is template if it recurs on this share of the host's pages; a wrapper keeps nodes down to the second share.
RECURS, KEPT = 0.3, 0.06
#: A leaf is a phrase of templates if of the hosts that show it this share of further pages does, or if so many hosts show it at all.
PHRASE, PHRASE_PAGES = 0.085, 8
#: A slot or container is a list of the template if no more than this share of its varying lines is prose.
PROSE = 0.05
#: What all hosts know of a slot weighs as much as so many lines of the host's own; what is usual in any slot, as so many lines of that.
PRIOR, USUAL = 10.0, 2.0

_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<!--.*?(?:-->|$)|<![^>]*>")
_CLASS = re.compile(r"class\s*=\s*[\"']([^\"']*)", re.I)
# fixed values: elements of HTML by what they are for
_VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}
_UNSEEN = {"head", "script", "style", "noscript", "template"}
_BLOCK = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "pre", "td", "th", "tr", "dt", "dd", "blockquote"}
_CONTAINER = {"body", "div", "header", "nav", "main", "article", "section", "aside", "footer", "form", "table", "td", "center", "ul", "ol", "dl", "details", "dialog", "fieldset"}
_ALONE, _TABULAR = {"li", "p", "td", "tr"}, {"td", "tr", "pre"}
_INLINE_LIST = {"ul", "ol", "dl", "table"}
_MD_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_SENTENCE = re.compile(r"[.!?:;。！？…][\"'”»)\]]*$")
_TRAIL = re.compile(r" (?:/|>|»|›|→|\|) ")
_BAR = re.compile(r"[^\W\d_][^\d|·>/•]{0,30}(?: ([|·>/•]) [^\W\d_][^\d|·>/•]{0,30}(?= \1|$)){3,}")
_APART = re.compile(r"[\W_]+")
_DIGITS, _NAME, _DOTTED = re.compile(r"\d+"), re.compile(r" (?<=[^\W\d_] )[A-ZÀ-Þ]\w*"), re.compile(r"\.[a-z]", re.I)
_MARK, _CODE = re.compile(r"\s{0,3}#{1,6}\s+|\s*[-*•]\s+"), re.compile(r"(?: {4}|\t)\S")
_WORD = re.compile(r"\w")
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[a-z]{2,}\b", re.I)


@dataclass
class Line:
    no: int
    text: str
    prose: bool
    holder: int
    own: int = 0
    key: int = 0
    title: bool = False


@dataclass
class Node:
    """A container (``tag``, ``cls``) or, with a ``key``, a leaf; ``n`` pages were aligned with it. ``at`` is a leaf's line or a container's number."""

    tag: str = ""
    cls: str = ""
    key: int = 0
    n: int = 1
    at: int = -1
    kids: list[Node] = field(default_factory=list)


def host_of(link: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@\s]*@)?([^/:?#\s]+)", link or "", re.I)
    return re.sub(r"^www\d?\.", "", m[1].lower().rstrip(".")) if m else ""


def _fold(text: str) -> str:
    return _APART.sub("", text.casefold())


def _h(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def parse(content: str, title: str | None = None, known: dict | None = None) -> tuple[list[tuple[int, str, str]], list[Line], str]:
    """Containers of a page (parent's number, tag, class; the first is the page), its visible lines in order, and its title.

    Only elements that stay open at the end of their line hold lines; parsing keeps a stack, so any depth will do. ``known``
    keeps keys of lines from page to page.
    """
    holders: list[tuple[int, str, str]] = [(-1, "page", "")]
    stack: list[tuple[str, int]] = [("page", 0)]
    lines: list[Line] = []
    head = ""
    anchors = unseen = 0  # how many open elements are links, and how many do not show
    for no, raw in enumerate(content.split("\n"), 1):
        marked = "<" in raw
        if unseen and not marked:
            continue
        text: list[str] = []
        tag, holder, linked, shown, at = "", -1, 0, 0, 0
        for m in _TAG.finditer(raw) if marked else ():
            piece = raw[at : m.start()]
            at = m.end()
            if piece:
                if "&" in piece:
                    piece = html.unescape(piece)
                if not unseen:
                    size = len(piece.strip())
                    if size:
                        holder = stack[-1][1] if holder < 0 else holder
                        shown += size
                        linked += size if anchors else 0
                    text.append(piece)
                elif stack[-1][0] == "title":
                    head = " ".join(piece.split()) or head
            close, name, attributes = m.groups()
            if not name:
                continue
            name = name.lower()
            if name in _VOID:
                if name == "br":
                    text.append(" ")
                continue
            if name in _BLOCK:
                text.append(" ")
                tag = tag or (name if not close else "")
            if close:
                k = len(stack) - 1
                while k and stack[k][0] != name:
                    k -= 1
                if k:
                    for t, _ in stack[k:]:
                        anchors -= t == "a"
                        unseen -= t in _UNSEEN
                    del stack[k:]
            elif not attributes or attributes[-1] != "/":
                if stack[-1][0] == name and name in _ALONE:
                    stack.pop()
                anchors += name == "a"
                unseen += name in _UNSEEN
                number = stack[-1][1]
                if name in _CONTAINER and not unseen:
                    cls = _CLASS.search(attributes) if attributes else None
                    holders.append((number, name, cls[1] if cls else ""))
                    number = len(holders) - 1
                stack.append((name, number))
        if at < len(raw) and not unseen:
            piece = html.unescape(raw[at:]) if "&" in raw else raw[at:]
            size = len(piece.strip())
            if size:
                holder = stack[-1][1] if holder < 0 else holder
                shown += size
                linked += size if anchors else 0
            text.append(piece)
        plain = "".join(text)
        if not marked:
            if _CODE.match(plain):
                tag = "pre"
            mark = _MARK.match(plain)
            plain = plain[mark.end() :] if mark else plain
            if "](" in plain:
                linked = shown if not _WORD.search(_MD_LINK.sub("", plain)) else 0
                plain = _MD_LINK.sub(r"\1", plain)
        tabs = "\t" in plain and "\t" in plain.strip()
        plain = " ".join(plain.split())
        if not _WORD.search(plain):
            continue
        free = linked < 0.9 * max(1, shown)
        prose = free and (tabs or tag in _TABULAR or len(plain) >= 100 or bool(_SENTENCE.search(plain)))
        lines.append(Line(no, plain, prose, max(holder, 0)))
    _keys(lines, title, head, {} if known is None else known)
    return holders, lines, title or head


def _keys(lines: list[Line], title: str | None, head: str, known: dict[tuple[str, str], tuple[int, int]]) -> None:
    """Keys of lines, ``known`` ones looked up: ``own`` of the text, ``key`` without what differs between sites that use the same phrase."""
    brand = re.split(r"\s[|–—-]\s", head)[-1] if re.search(r"\s[|–—-]\s", head) else ""
    for line in reversed(lines):
        m = line.text[0] == "©" and re.match(r"©\s*(?:\d{4}\s*[-–]?\s*)+(.+?)(?:[.,|]|$)", line.text)
        if m:
            brand = m[1].strip()
            break
    names = {w for t in (title, re.split(r"\s[|–—]\s", head)[0]) if t and (w := _fold(t))}
    trails = [_fold(parts[-1]) if " " in x.text and len(parts := _TRAIL.split(x.text)) > 1 else "" for x in lines]
    named = re.compile(re.escape(brand), re.I) if len(brand) > 2 else None
    if not names:  # a page without a title is called what the trail above its first lines ends in
        names = {t for t, x in zip(trails, lines[1:], strict=False) if t and _fold(x.text) == t}
    longest = max((3 * len(w) + 40 for w in names), default=0)
    for line, trail in zip(lines, trails, strict=True):
        if len(line.text) <= longest and _fold(line.text) in names:
            line.title = True
        elif trail and trail in names:
            line.own = line.key = _h("\x03trail")  # a trail of links that ends in the page's title
        elif _BAR.fullmatch(line.text):
            line.own, line.key = _h(line.text), _h("\x03bar")  # a row of names: the same thing whatever they are
        else:
            keys = known.get((brand, line.text))
            if keys is None:
                keys = known[brand, line.text] = _h(line.text), _h(masked(line.text, named))
            line.own, line.key = keys


def masked(text: str, brand: re.Pattern | None = None) -> str:
    """A text without what differs between sites that use the same phrase: their names, numbers, names within a sentence."""
    if brand:
        text = brand.sub("\x01", text)
    if _DOTTED.search(text):
        text = _DOMAIN.sub("\x02", text)
    return _NAME.sub(" X", _DIGITS.sub("9", text))


def frame_key(text: str) -> int | None:
    """What is left of an announcement without what it announces: its words up to the colon, and its last two."""
    m = ": " in text and re.match(r"((?:\S+ ){0,2}\S+?) ?: .*[.!?] (\S+(?: \S+){1,3})$", text)
    return _h(f"{m[1]}:{m[2]}") if m else None


def tree(holders: list[tuple[int, str, str]], leaves: list[tuple[int, int, int]]) -> Node:
    """The tree of a page from its containers and leaves (key, container, line), in order; containers without leaves are left out.

    Lists and tables within a container that holds other lines belong to it.
    """
    nodes: dict[int, Node] = {}

    def node(k: int) -> Node:
        way = []
        while k not in nodes:
            way.append(k)
            k = holders[k][0]
            if k < 0:
                nodes[way[-1]] = Node("page", at=0)
                k = way.pop()
        for k in reversed(way):
            up = nodes[holders[k][0]]
            nodes[k] = Node(holders[k][1], holders[k][2], at=k)
            up.kids.append(nodes[k])
        return nodes[k]

    root = node(0)
    for key, holder, at in leaves:
        node(holder).kids.append(Node(key=key, at=at))
    return root


def align(a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
    """Simple tree matching: weight of the best order-keeping mapping of two trees of equal label, and what it maps.

    Recursion goes as deep as containers part from each other. A leaf weighs 1, a container a little by itself, more if its class is the same.
    """
    x, y = a.kids, b.kids
    pairs: list[tuple[Node, Node]] = [(a, b)]
    total = 0.3 + (0.7 if a.cls == b.cls else 0.0)
    lo = 0
    while lo < min(len(x), len(y)) and x[lo].key and x[lo].key == y[lo].key:  # equal leaves at either end always belong together
        pairs.append((x[lo], y[lo]))
        lo += 1
    p, q = len(x), len(y)
    while p > lo and q > lo and x[p - 1].key and x[p - 1].key == y[q - 1].key:
        p, q = p - 1, q - 1
        pairs.append((x[p], y[q]))
    total += len(pairs) - 1
    x, y = x[lo:p], y[lo:q]
    if not x or not y:
        return total, pairs
    keys = {k.key for k in y}
    tags = {k.tag for k in y if not k.key}
    x = [k for k in x if (k.key in keys if k.key else k.tag in tags)]
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    found: dict[tuple[int, int], tuple[float, list]] = {}
    for i, u in enumerate(x, 1):
        row, up = best[i], best[i - 1]
        for j, v in enumerate(y, 1):
            most = row[j - 1] if row[j - 1] > up[j] else up[j]
            if u.key == v.key and (u.key or u.tag == v.tag):
                w = 1.0
                if not u.key:
                    w = (found.setdefault((i, j), align(u, v)))[0]
                if up[j - 1] + w > most:
                    most = up[j - 1] + w
            row[j] = most
    i, j = len(x), len(y)
    total += best[i][j]
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += found[i + 1, j + 1][1] if not x[i].key else [(x[i], y[j])]
    return total, pairs


def merge(wrapper: Node, other: Node) -> None:
    """``other`` merged into ``wrapper``: aligned nodes add up their pages, others come in after the sibling they follow."""
    _, pairs = align(wrapper, other)
    mine = {id(b): a for a, b in pairs}
    for a, b in pairs:
        a.n += b.n
    for a, b in pairs:
        if b.key or all(id(k) in mine for k in b.kids):
            continue
        place = {id(k): i for i, k in enumerate(a.kids)}
        out, at = [], 0
        for k in b.kids:
            if id(k) in mine:
                i = place[id(mine[id(k)])] + 1
                out += a.kids[at:i]
                at = i
            else:
                out.append(k)
        a.kids = out + a.kids[at:]


def kept(node: Node, least: float) -> Node:
    """A wrapper without the nodes that fewer than ``least`` pages show."""
    todo = [node]
    while todo:
        k = todo.pop()
        k.kids = [c for c in k.kids if c.n >= least]
        todo += k.kids
    return node


def _dumps(node: Node) -> str:
    out, todo = [], [(0, node)]
    while todo:
        depth, k = todo.pop()
        out.append([depth, k.n, k.key] if k.key else [depth, k.n, k.tag, k.cls])
        todo += [(depth + 1, c) for c in reversed(k.kids)]
    return json.dumps(out, separators=(",", ":"))


def _loads(text: str) -> Node:
    way: list[Node] = []
    for depth, n, *label in json.loads(text):
        node = Node(key=label[0], n=n) if len(label) == 1 else Node(label[0], label[1], 0, n)
        del way[depth:]
        if way:
            way[-1].kids.append(node)
        way.append(node)
    return way[0]


def _pages(df: DataFrame, id_col: Column, link: Column, title: Column, content: Column) -> DataFrame:
    columns = [id_col.cast("bigint").alias("id"), link.cast("string").alias("link"), title.cast("string").alias("title"), content.cast("string").alias("content")]
    return df.select(*columns).where(F.col("content").isNotNull() & F.col("id").isNotNull())


_PARSED = "id bigint, host string, page bigint, holders string, nos array<int>, holder array<int>, own array<bigint>, key array<bigint>, frame array<bigint>, flags array<int>, name bigint"
_PROSE_FLAG, _TITLE_FLAG = 1, 2


def _needed(holders: list[tuple[int, str, str]], lines: list[Line]) -> tuple[list[tuple[int, str, str]], dict[int, int]]:
    """The containers that hold lines or part others from each other, and the new number of each that holds lines."""
    own = {x.holder for x in lines} | {0}
    inside: dict[int, set[int]] = {}
    todo = list(own)
    while todo:  # every container on the way up, with its children on that way
        k = todo.pop()
        up = holders[k][0]
        if up >= 0:
            if up not in inside and up not in own:
                todo.append(up)
            inside.setdefault(up, set()).add(k)
    small: list[tuple[int, str, str]] = []
    number: dict[int, int] = {}
    way = [(0, -1)]
    while way:
        k, up = way.pop()
        if k in own or len(inside[k]) > 1:
            small.append((up, holders[k][1], holders[k][2]))
            up = number[k] = len(small) - 1
        way += [(c, up) for c in sorted(inside.get(k, ()), reverse=True)]
    return small, number


sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # align recurses in Python code only


def _parsed(batches):
    """What later steps need of a page: no text, but its containers, and of its lines number, container, keys and flags."""
    names = [c.split()[0] for c in _PARSED.split(", ")]
    known: dict[tuple[str, str], tuple[int, int]] = {}
    for b in batches:
        if len(known) > 200_000:
            known.clear()
        cols: list[list] = [[] for _ in names]
        for key, link, title, content in zip(*(b.column(c).to_pylist() for c in ("id", "link", "title", "content")), strict=True):
            host = host_of(link)
            holders, lines, name = parse(content, title, known)
            small, number = _needed(holders, lines)
            row = (
                key, host, _h(_fold(name) or str(key)), json.dumps(small), [x.no for x in lines], [number[x.holder] for x in lines], [x.own for x in lines], [x.key for x in lines],
                [frame_key(x.text) or 0 for x in lines], [_PROSE_FLAG * x.prose + _TITLE_FLAG * x.title for x in lines], _h(masked(" ".join((title or "").split()))),
            )
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _leaves(own, holder, flags, among=None) -> list[tuple[int, int, int]]:
    return [(k, c, i) for i, (k, c, f) in enumerate(zip(own, holder, flags, strict=True)) if not f & _TITLE_FLAG and (among is None or k in among)]


def _wrapped(pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of one group of pages of a host: every title counts once, leaves that no other page of the group has are left out."""
    pdf = pdf.sort_values("id").drop_duplicates("page")
    holder_lists, own_lists, flag_lists = ([x.tolist() for x in pdf[c]] for c in ("holder", "own", "flags"))
    seen: dict[int, int] = {}
    for own, flags in zip(own_lists, flag_lists, strict=True):
        for k in {k for k, f in zip(own, flags, strict=True) if not f & _TITLE_FLAG}:
            seen[k] = seen.get(k, 0) + 1
    several = {k for k, n in seen.items() if n > 1} if len(pdf) > 1 else set(seen)
    wrapper = None
    for holders, holder, own, flags in zip(pdf["holders"], holder_lists, own_lists, flag_lists, strict=True):
        page = tree(json.loads(holders), _leaves(own, holder, flags, several))
        if wrapper is None:
            wrapper = page
        else:
            merge(wrapper, page)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [int(pdf["part"].iloc[0])], "wrapper": [_dumps(kept(wrapper, KEPT * len(pdf)))]})


def _remerged(pdf: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in pdf.sort_values("part")["wrapper"]:
        other = _loads(text)
        if wrapper is None:
            wrapper = other
        else:
            merge(wrapper, other)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [int(pdf["into"].iloc[0])], "wrapper": [_dumps(kept(wrapper, KEPT * wrapper.n))]})


def wrappers(parsed: DataFrame) -> DataFrame:
    """host and wrapper, from all its pages: groups of pages first, then partial wrappers in rounds, so that no task holds a large host."""
    pages = parsed.where(F.col("host") != "").select("id", "host", "page", "holders", "holder", "own", "flags")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    placed = split_join(pages, sizes, "host", "inner").withColumn("part", F.pmod(F.xxhash64("page"), F.ceil(F.col("n") / GROUP)))
    done = write_out(placed.groupBy("host", "part").applyInPandas(_wrapped, "host string, part bigint, wrapper string"))
    while (done.agg(F.max("part")).first()[0] or 0) > 0:
        merged = done.withColumn("into", F.floor(F.col("part") / MERGED)).groupBy("host", "into")
        done = write_out(merged.applyInPandas(_remerged, "host string, part bigint, wrapper string"))
    return done.select("host", "wrapper")


def template_phrases(parsed: DataFrame) -> DataFrame:
    """Keys of leaves that recur over all hosts: key, share of pages that show it, and whether it is a phrase (titles of pages never are).

    Pages of one title count once.

    Of every host that shows a key one page is set aside, the one that made it known; the share of its other pages tells how
    often the host's template has it. Where most hosts are small, the share of hosts whose first page shows it tells the same.
    """
    keys = F.array_distinct(F.concat("key", "frame"))
    once = parsed.groupBy("host", "page").agg(F.min_by(keys, "id").alias("keys"), F.min("id").alias("id"))
    once = once.withColumn("site", F.when(F.col("host") == "", F.concat(F.lit("\x01"), F.col("id").cast("string"))).otherwise(F.col("host")))
    hosts = once.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first"))
    total = hosts.agg(F.count(F.lit(1)).alias("hosts"))
    seen = once.select("site", "page", F.explode("keys").alias("key")).where(F.col("key") != 0)
    seen = seen.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("least"))
    pooled = seen.join(hosts, "site").groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("more"), F.sum(F.col("n_pages") - 1).alias("of"), F.count_if(F.col("least") == F.col("first")).alias("firsts")
    )
    titles = parsed.select(F.col("name").alias("key"), F.lit(True).alias("titled")).distinct()
    share = F.greatest(F.coalesce(F.col("more") / F.nullif("of", F.lit(0)), F.lit(0.0)), F.col("firsts") / F.col("hosts"))
    common = pooled.join(F.broadcast(total)).where(F.col("n") >= PHRASE_PAGES).select("key", share.alias("share"))  # one row
    common = common.join(titles, "key", "left")
    return common.select("key", "share", (F.col("titled").isNull() & (F.col("share") >= PHRASE)).alias("phrase"))


class _Wrapper:
    """A wrapper as pages are aligned with it: its tree without leaves that recur too seldom, and the names of its containers."""

    def __init__(self, text: str):
        self.root = kept_leaves(_loads(text))
        self.keys = {k for k, _ in _keys_of(self.root)}
        self.names = _names(self.root)


def kept_leaves(root: Node) -> Node:
    """A wrapper with all its containers, but only the leaves that recur."""
    todo = [root]
    while todo:
        k = todo.pop()
        k.kids = [c for c in k.kids if not c.key or c.n > 1 and c.n >= RECURS * root.n]
        todo += k.kids
    return root


def _slots(batches):
    """Per visible line that does not recur: its container in the wrapper (``region``), the recurring line it follows there (``slot``), and what it is."""
    lately: dict[str, _Wrapper] = {}
    columns = ["id", "host", "wrapper", "holders", "nos", "holder", "own", "key", "frame", "flags", "known", "shares", "told"]
    for b in batches:
        cols: list[list] = [[] for _ in range(7)]
        for page, host, wrapper, containers, nos, holder, own, key, frame, flags, known, shares, told in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            holders = json.loads(containers)
            share = dict(zip(known or (), shares or (), strict=True))
            phrases = {k for k, t in zip(known or (), told or (), strict=True) if t}
            constant: set[int] = set()
            names = {0: "page"}
            if wrapper:
                if (w := lately.get(wrapper)) is None:
                    if len(lately) >= 256:  # pages come in the order of their hosts or nearly so
                        lately.clear()
                    w = lately[wrapper] = _Wrapper(wrapper)
                for a, p in align(w.root, tree(holders, _leaves(own, holder, flags, w.keys)))[1]:
                    if not p.key:
                        names[p.at] = w.names[id(a)]
                    elif _recurs(a.n, w.root.n, share.get(key[p.at])):
                        constant.add(p.at)
            for k, (up, tag, cls) in enumerate(holders):
                if k and tag in _INLINE_LIST:
                    names[k] = names[up]  # a list is part of what it stands in
                elif k not in names:
                    names[k] = f"{names[up]}/{tag}.{cls}~{k}"
            last: dict[str, int] = {}
            for i, flag in enumerate(flags):
                region = names[holder[i]]
                fixed = not flag & _TITLE_FLAG and (key[i] in phrases or frame[i] in phrases or i in constant)
                if fixed:
                    last[region] = key[i]
                    continue
                for c, v in zip(cols, (page, nos[i], host, region, last.get(region, 0), bool(flag & _PROSE_FLAG), bool(flag & _TITLE_FLAG)), strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "line_no", "host", "region", "slot", "prose", "title"])


def _recurs(n: int, of: int, share: float | None) -> bool:
    """Whether enough of a host's pages show a leaf; what all hosts know of its share counts as some pages more."""
    return n >= RECURS * of if share is None else n + PRIOR * share >= RECURS * (of + PRIOR)


def _keys_of(node: Node) -> list[tuple[int, int]]:
    out, todo = [], [node]
    while todo:
        k = todo.pop()
        if k.key:
            out.append((k.key, k.n))
        todo += k.kids
    return out


def _names(node: Node) -> dict[int, str]:
    """What each container of a wrapper is called: its place among its siblings, from the page down."""
    out, todo = {}, [(node, "page")]
    while todo:
        k, name = todo.pop()
        out[id(k)] = name
        todo += [(c, f"{name}/{c.tag}.{c.cls}#{i}") for i, c in enumerate(k.kids) if not c.key]
    return out


def main_content(df: DataFrame, id_col: Column, link: Column, title: Column, content: Column) -> DataFrame:
    """id and line_no (from 1, content split at line feeds) of each line of the article that holds visible text.

    Contents are read once and never shuffled; what is shuffled are keys of their lines. Hosts of any size are treated alike,
    one of a third of all rows being split into groups. Rows that repeat count once. Null and empty contents give no rows;
    pages without a link are judged by what all hosts have in common.
    """
    pages = spread(_pages(df, id_col, link, title, content))
    parsed = write_out(pages.mapInArrow(_parsed, _PARSED))
    phrases = write_out(template_phrases(parsed))
    told = parsed.select("id", F.explode(F.array_distinct(F.concat("key", "frame"))).alias("key"))
    marked = split_join(told, phrases, "key", "inner").groupBy("id").agg(F.collect_set(F.struct("key", "share", "phrase")).alias("phrases"))
    work = split_join(parsed.drop("name", "page"), wrappers(parsed), "host").join(write_out(marked), "id", "left")
    work = work.select("*", F.col("phrases.key").alias("known"), F.col("phrases.share").alias("shares"), F.col("phrases.phrase").alias("told")).drop("phrases")
    found = "id bigint, line_no bigint, host string, region string, slot bigint, prose boolean, title boolean"
    lines = write_out(work.mapInArrow(_slots, found))

    site = F.when(F.col("host") == "", F.concat(F.lit("\x01"), F.col("id").cast("string"))).otherwise(F.col("host"))
    vary = lines.withColumn("region_key", F.concat_ws("\x02", site, "region"))
    vary = vary.withColumn("slot_key", F.concat_ws("\x02", "region_key", F.col("slot").cast("string")))
    counted = [F.count_if(~F.col("title")).alias("lines"), F.count_if(F.col("prose") & ~F.col("title")).alias("prose"), F.count_if("title").alias("titles")]
    by_slot = write_out(vary.groupBy("region_key", "slot_key", "slot").agg(*counted))
    regions = by_slot.groupBy("region_key").agg(*[F.sum(c).alias(c) for c in ("lines", "prose", "titles")])
    lists = regions.where(F.greatest("prose", "titles") <= PROSE * F.col("lines")).select("region_key", F.lit(True).alias("list"))
    usual = by_slot.agg((F.sum("prose") / F.sum("lines")).alias("usual"))
    pool = by_slot.groupBy("slot").agg(F.sum("prose").alias("p"), F.sum("lines").alias("l")).join(F.broadcast(usual))  # one row
    pool = pool.select("slot", ((F.col("p") + USUAL * F.col("usual")) / (F.col("l") + USUAL)).alias("pooled"))
    share = (F.col("prose") + PRIOR * F.col("pooled")) / (F.col("lines") + PRIOR)
    known = split_join(by_slot, pool, "slot").join(lists, "region_key", "left")
    gone = write_out(known.where(F.col("list") | (F.col("slot") != 0) & (share <= PROSE)).select("slot_key", F.lit(True).alias("gone")))
    body = split_join(vary.where("NOT title"), gone, "slot_key").where("gone IS NULL").select("id", "line_no")
    return body.unionByName(lines.where("title").select("id", "line_no")).distinct()

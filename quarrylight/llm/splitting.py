"""Cutting oversized texts at natural boundaries, by packing a tree of their structure.

A text is parsed into a tree: sections under headings, lists by their indentation and elements of markup by their nesting
are made of paragraphs (and, within a paragraph, of lines); paragraphs hold lines, lines sentences, sentences words. From
the bottom up neighbouring subtrees of one parent are merged as long as they fit; only a node that does not fit by itself
is opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import spread

LIMIT, OVERLAP = 2400, 200
#: What a text is cut between, from the coarsest to the finest unit.
UNITS = ("paragraph", "line", "sentence", "word", "char")
_BREAK = r"(?:\r\n|\n|\r(?!\n))"
#: Where a unit ends. A paragraph ends at lines without visible text, a sentence after its mark.
_ENDS = {
    "paragraph": re.compile(rf"{_BREAK}(?:[^\S\r\n]*{_BREAK})+"),
    "line": re.compile(_BREAK),
    "sentence": re.compile(rf"(?<=[.!?])\s+|(?<=[。！？])|{_BREAK}"),
    "word": re.compile(r"\s+"),
}
_HEADING = re.compile(r"[^\S\r\n]*(?:(#{1,6})[^\S\r\n]+\S|<h([1-6])\b)", re.I)
_ITEM = re.compile(r"([^\S\r\n]*)(?:[-*+•]|\d{1,3}[.)])[^\S\r\n]+\S")
_INDENT = re.compile(r"[^\S\r\n]+\S")
_ELEMENT = re.compile(r"<(/?)(ul|ol|dl|li|dt|dd|table|tr|section|article|div|blockquote|p)\b", re.I)
#: Ranks in an outline: headings 1 to 6, then elements by their nesting, then list items by their indentation.
_MARKUP, _LIST = 10, 1000


@dataclass
class Node:
    """text[start:end]; its children are parts of it that follow each other without a gap, cut between ``unit``s."""

    start: int
    end: int
    unit: str
    children: list[Node] = field(default_factory=list)


def _spans(text: str, lo: int, hi: int, unit: str) -> list[tuple[int, int]]:
    """Units of text[lo:hi] that follow each other without a gap; white space after a unit belongs to it."""
    if unit == "char":
        return [(k, k + 1) for k in range(lo, hi)]
    out, at = [], lo
    for m in _ENDS[unit].finditer(text, lo, hi):
        if at < m.end() < hi:
            out.append((at, m.end()))
            at = m.end()
    return [*out, (at, hi)]


def _ranks(text: str, spans: list[tuple[int, int]]) -> Iterator[int | None]:
    """The rank in the outline of each paragraph or line, by what it starts with: None for plain text, 0 for what ends a list."""
    nested, listed = 0, False
    for a, b in spans:
        heading, item, element = (shape.match(text, a, b) for shape in (_HEADING, _ITEM, _ELEMENT))
        if heading:
            yield len(heading[1] or "") or int(heading[2])
        elif item:
            yield _LIST + len(item[1].expandtabs(4))
        elif element and not element[1]:
            yield _MARKUP + nested
        else:
            yield None if not listed or _INDENT.match(text, a, b) else 0
        listed = bool(item) or listed and bool(_INDENT.match(text, a, b))
        nested = min(_LIST - _MARKUP - 1, max(0, nested + sum(-1 if m[1] else 1 for m in _ELEMENT.finditer(text, a, b))))


def _outline(text: str, root: Node, spans: list[tuple[int, int]]) -> Node:
    """``root`` with the spans below it, each under the last one of lower rank; plain ones stay where they stand."""
    open_nodes: list[tuple[int, Node]] = [(0, root)]
    for (a, b), rank in zip(spans, _ranks(text, spans), strict=True):
        leaf = Node(a, b, root.unit)
        if rank == 0:
            while open_nodes[-1][0] >= _LIST:
                open_nodes.pop()
        elif rank is not None:
            while open_nodes[-1][0] >= rank:
                open_nodes.pop()
            group = Node(a, b, root.unit)
            open_nodes[-1][1].children.append(group)
            open_nodes.append((rank, group))
        open_nodes[-1][1].children.append(leaf)
        for _, node in open_nodes:
            node.end = max(node.end, b)
    return root


def parse(text: str) -> Node:
    """The tree of a text down to its paragraphs; finer parts are parsed where a node is opened."""
    return _outline(text, Node(0, len(text), "paragraph"), _spans(text, 0, len(text), "paragraph"))


def _opened(text: str, node: Node) -> Node:
    """A node with its children: those it has, or its parts between the next finer unit."""
    if node.children:
        return node
    finer = UNITS[UNITS.index(node.unit) + 1]
    inside = Node(node.start, node.end, finer)
    spans = _spans(text, node.start, node.end, finer)
    if finer == "line":
        return _outline(text, inside, spans)
    inside.children = [Node(a, b, finer) for a, b in spans]
    return inside


def _width(text: str, lo: int, hi: int) -> int:
    return len(text[lo:hi].strip())


def pack(text: str, root: Node, limit: int, room: int) -> tuple[list[tuple[int, int]], str]:
    """Parts of at most ``limit`` characters, and the finest unit they are cut between.

    Children that fit are merged with their neighbours up to ``room``; what a child that does not fit was cut into is left
    as it is. A stack stands in for recursion, as lists and elements may be nested deeply.
    """
    out: list[tuple[int, int]] = []
    finest, mergeable = 0, False
    todo = [root]
    while todo:
        node = todo.pop()
        if node is None:  # an opened node ends: nothing merges across its border
            mergeable = False
            continue
        size = node.end - node.start
        if mergeable and node.end - out[-1][0] <= room:
            out[-1] = (out[-1][0], node.end)
        elif size <= limit:
            out.append((node.start, node.end))
            mergeable = True
        elif _width(text, node.start, node.end) <= limit:  # only its outer white space is too much
            end = node.start + len(text[node.start : node.end].rstrip())
            out += [(k, min(k + limit, stop)) for first, stop in ((node.start, end), (end, node.end)) for k in range(first, stop, limit)]
            mergeable = False
        elif node.unit == "word" and not node.children:
            finest = len(UNITS) - 1
            out += [(k, min(k + room, node.end)) for k in range(node.start, node.end, room)]
            mergeable = False
        else:
            inside = _opened(text, node)
            finest = max(finest, UNITS.index(inside.unit))
            todo += [None, *reversed(inside.children), None]
    return out, UNITS[finest]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], str]:
    """(from, start, end) of each piece text[from:end], and the unit they are cut between.

    text[from:start] repeats the end of the piece before; the parts text[start:end] follow each other without a gap. A unit
    that fits is never cut for the overlap's sake: the overlap is shortened instead, and starts at a word where one starts
    within it.
    """
    parts, unit = pack(text, parse(text), limit, limit - overlap)
    out: list[tuple[int, int, int]] = []
    for start, end in parts:
        back = min(overlap, start, limit - (end - start)) if out else 0
        if back:
            word = re.search(r"(?<=\s)\S", text[start - back - 1 : start])
            if word:
                back -= word.start() - 1
        out.append((start - back, start, end))
    return out, unit


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit:
        raise ValueError(f"the overlap must be at least 0 and below the limit, not {overlap} and {limit}")


def split_oversized(df: DataFrame, id_col: Column, text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text longer than ``limit``: id, boundary, piece_no (from 1), start, n_overlap, piece.

    ``boundary`` is the finest unit that had to be opened, which is the coarsest of which every single one fits. Null and
    shorter texts give no rows; white space alone is cut like other text. Rows that repeat are cut again.
    """
    _check(limit, overlap)

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"], strict=True):
                parts, unit = pieces(text, limit, overlap)
                rows += [(key, unit, k, start, start - first, text[first:end]) for k, (first, start, end) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["id", "boundary", "piece_no", "start", "n_overlap", "piece"])

    src = spread(df.select(id_col.alias("id"), text.alias("text")).where(F.length("text") > limit))
    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, boundary string, piece_no bigint, start bigint, n_overlap bigint, piece string")

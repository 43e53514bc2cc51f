"""Column functions on plain text and markdown: cleaning, tokens, patterns. A null text gives null, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, and the four separators that Python's ``\s`` counts too.
SPACE = r"[\s\x1c-\x1f]"

# fixed values: the patterns by which content is recognized
HTML = r"</?(?:div|span|p|h[1-6]|ul|ol|li|table|html|body|head)(?:\s|>)"
MD_HEADING = r"(?m)^#{1,6}\s+\w+"
MD_LIST = r"(?m)^\s*[-*+]\s+\w+"
MD_CODE = r"(?m)^```\w*$"
PDF_MARKER = r"(?i)\bpage\s+\d+\s+of\s+\d+\b"
VIDEO = r"(?i)https?://(?:(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)|(?:www\.)?vimeo\.com/|(?:www\.)?loom\.com/share/|(?:www\.)?wistia\.com/|(?:player\.)?vimeo\.com/video/|(?:www\.)?dailymotion\.com/video/)[a-zA-Z0-9_\-]+"
FIELDS = {
    "title": r"(?d)(?:Title|TITLE):\s*(.+)(?:\n|$)",
    "author": r"(?d)(?:Author|AUTHOR):\s*(.+)(?:\n|$)",
    "date": r"(?d)(?:Date|DATE):\s*(.+)(?:\n|$)",
    "subject": r"(?d)(?:Subject|SUBJECT):\s*(.+)(?:\n|$)",
}
FENCED, INLINE_CODE, EMPHASIS, HEADING_MARK = r"(?s)```.*?```", r"`([^`]+)`", r"[*_]{1,2}([^*_]+)[*_]{1,2}", r"(?dm)^#{1,6}\s+"
FIRST_HEADING, HEADING = r"(?dm)^#\s+(.+)$", r"(?dm)^(#{1,6})\s+(.+)$"
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n\s*---\s*\n"
LIST_ITEM, CODE_LANGUAGE, CODE_BLOCK = r"(?dm)^(?:[*\-+]|\d+\.)\s+(.+)$", r"```(\w+)", r"(?s)```(?:\w+)?\n(.*?)```"
MD_IMAGE, MD_LINK = r"!\[[^\]]*\]\(([^)]+)\)", r"\[([^\]]+)\]\(([^)]+)\)"
TOKEN, UNSAFE_IN_NAMES = r"(?U)(\w+|[^\w\s\x1c-\x1f])", r"(?U)[^\w\s.-]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(c: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(c, f"(?U){SPACE}+", " ")


def normalize_newlines(c: Column) -> Column:
    """White space from a line end on as one line feed; trimmed."""
    return strip(F.regexp_replace(c, rf"(?U)\n{SPACE}*", "\n"))


def clean_text(c: Column, whitespace: bool = True, newlines: bool = True, max_length: int | None = None) -> Column:
    """White space collapsed and trimmed; line ends merged only where that is off, as collapsing removes them; cut to a length."""
    if whitespace:
        c = F.trim(normalize_whitespace(c))
    elif newlines:
        c = F.regexp_replace(c, r"\n{2,}", "\n\n")
    return truncate(c, max_length) if max_length else c


def truncate(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def as_string(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_markdown(c: Column) -> Column:
    """Without fenced code blocks; inline code without its marks."""
    return F.regexp_replace(F.regexp_replace(c, FENCED, ""), INLINE_CODE, "$1")


def strip_markdown(c: Column) -> Column:
    """Without the marks of headings, emphasis and inline code."""
    c = F.regexp_replace(c, HEADING_MARK, "")
    c = F.regexp_replace(c, EMPHASIS, "$1")
    return F.regexp_replace(c, INLINE_CODE, "$1")


def content_type(c: Column) -> Column:
    """html, markdown or text; null for null."""
    md = c.rlike("(?d)" + MD_HEADING) | c.rlike("(?d)" + MD_LIST) | c.rlike("(?d)" + MD_CODE)
    return F.when(c.isNull(), None).when(c.rlike(HTML), "html").when(md, "markdown").otherwise("text")


def words(c: Column) -> Column:
    """Words between white space; an empty array for empty text."""
    return F.filter(F.split(c, f"(?U){SPACE}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(c, F.lit(TOKEN), 1)


def count_tokens(c: Column, mode: str = "word") -> Column:
    """Estimated tokens: the number of words, or a quarter of the characters. Null counts as empty."""
    if mode == "word":
        return F.coalesce(F.size(words(c)), F.lit(0)).cast("bigint")
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")


def sentences(c: Column) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark."""
    return F.filter(F.split(c, rf"(?U)(?<=[.!?]){SPACE}+"), lambda s: s != "")


def field_line(c: Column, name: str) -> Column:
    """The rest of the first line that starts a named field (title, author, date, subject); null if there is none."""
    return F.nullif(F.regexp_extract(c, FIELDS[name], 1), F.lit(""))


def first_heading(c: Column) -> Column:
    """Text of the first heading of rank 1 in markdown; null if there is none."""
    return F.nullif(F.regexp_extract(c, FIRST_HEADING, 1), F.lit(""))


def outline(c: Column) -> Column:
    """Headings of markdown in order: level and text."""
    return F.arrays_zip(F.transform(F.regexp_extract_all(c, F.lit(HEADING), 1), F.length).alias("level"), F.regexp_extract_all(c, F.lit(HEADING), 2).alias("text"))


def front_matter(c: Column) -> Column:
    """Keys and values of the leading block between dashes; null if there is none."""
    block = F.nullif(F.regexp_extract(c, FRONT_MATTER, 1), F.lit(""))
    pairs = F.filter(F.split(block, r"\n"), lambda x: x.contains(":"))
    key = F.transform(pairs, lambda x: F.trim(F.substring_index(x, ":", 1)))
    value = F.transform(pairs, lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    return F.map_from_arrays(F.array_distinct(key), F.transform(F.array_distinct(key), lambda k: F.element_at(value, F.array_position(key, k).cast("int"))))


def list_items(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LIST_ITEM), 1)


def code_languages(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CODE_LANGUAGE), 1)


def code_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CODE_BLOCK), 1)


def markdown_images(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MD_IMAGE), 1)


def markdown_links(c: Column) -> Column:
    """Links of markdown: text and target."""
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(MD_LINK), 1).alias("text"), F.regexp_extract_all(c, F.lit(MD_LINK), 2).alias("target"))


def contains_word(c: Column, keyword: str) -> Column:
    """Whether a keyword stands in a text as a whole word."""
    return c.rlike(r"(?U)\b\Q" + keyword.replace("\\E", "") + r"\E\b")


def safe_name(c: Column) -> Column:
    """A file name without characters that file systems mind."""
    return F.regexp_replace(c, UNSAFE_IN_NAMES, "")

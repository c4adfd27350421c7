"""Conversions that need a scan with state: HTML to Markdown, bold repair, and packing of paragraphs. All run as Arrow UDFs over batches."""

from __future__ import annotations

import bisect
import itertools
import operator
import re
import unicodedata
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What closes a bold span and opens the next, with the blanks between.
GAP = re.compile(r"(?<=\S)\*\*([ \t]*)\*\*(?=\S)")
#: A line's first bold span, with what touches it.
FIRST_SPAN = re.compile(r"^([ \t]*\*\*(?:(?!\*\*).)*\*\*)(?=\S)", re.MULTILINE)


class Writer(HTMLParser):
    """Headings, paragraphs, nested lists, tables, quotes, code, images and emphasis as Markdown."""

    SKIP = frozenset(("script", "style", "head", "noscript"))
    BLOCK = frozenset(("p", "div", "section", "article", "ul", "ol", "table", "blockquote", "pre", "nav", "header", "footer"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.skipped = self.code = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif self.skipped:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind, n = self.lists[-1] if self.lists else ("ul", 0)
            if self.lists:
                self.lists[-1][1] = n + 1
            self.out.append("\n" + "\t" * max(len(self.lists) - 1, 0) + ("- " if kind == "ul" else f"{n + 1}. "))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "img":
            self.out.append(f"![]({dict(attrs).get('src') or ''})")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "pre":
            self.code += 1
            self.out.append("\n\n```\n")
        elif tag in self.BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n" if not self.lists else "")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag in ("td", "th"):
            self.out.append("|")
        elif tag == "pre":
            self.code = max(0, self.code - 1)
            self.out.append("\n```\n\n")
        elif tag in self.BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data if self.code else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    if not html or not html.strip():
        return None
    w = Writer()
    w.feed(html)
    w.close()
    text = "\n".join(line.rstrip() for line in "".join(w.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip() or None


def merged_bold(text: str) -> str:
    """Bold spans with nothing but blanks between become one, the blanks stay, until nothing changes."""
    while (once := GAP.sub(r"\1", text)) != text:
        text = once
    return text


def edged(c: str) -> bool:
    return c == "_" or c.isspace() or unicodedata.category(c)[0] in "PZ"


def spaced_bold(text: str) -> str:
    """Walks pairs of ``**``; a span that has punctuation or a blank at an edge is set apart from what it touches there."""
    parts = text.split("**")
    pairs = (len(parts) - 1) // 2
    out = []
    for i in range(pairs):
        before, span, after = parts[2 * i : 2 * i + 3]
        left = bool(span and before and edged(span[0]) and not before[-1].isspace())
        touched = after[:1] or ("*" if 2 * i + 3 < len(parts) else "")
        right = bool(span and touched and edged(span[-1]) and not touched.isspace())
        out.append(before + " " * left + "**" + span + "**" + " " * right)
    return "".join(out) + "**".join(parts[2 * pairs :])


def spaced_first_bold(text: str) -> str:
    """A space after a bold span that a line begins with, where text follows at once."""
    return FIRST_SPAN.sub(r"\1 ", text)


def normal_bold(text: str | None) -> str | None:
    """X20, X21 and X22 in this order."""
    return None if text is None else spaced_first_bold(spaced_bold(merged_bold(text)))


def chunk_numbers(lengths: Iterable[int], most: int) -> Iterator[int]:
    """The chunk of each block, by a running length: a block stays with those before while they have ``most`` characters together."""
    number, used = -1, most + 1
    for n in lengths:
        fits = used + n <= most
        number, used = (number, used + n) if fits else (number + 1, n)
        yield number


def packed(blocks: list[str], most: int) -> list[str]:
    """Blocks in order in chunks of up to ``most`` characters, joined by line feeds and trimmed; a larger block is cut into slices."""
    out: list[str] = []
    for _, group in itertools.groupby(zip(chunk_numbers(map(len, blocks), most), blocks), operator.itemgetter(0)):
        members = [b for _, b in group]
        large = len(members[0]) > most
        out += textsliced(members[0], most) if large else ["\n".join(members).strip()]
    return [c for c in out if not c.isspace() and c]


def textsliced(text: str, size: int) -> list[str]:
    return ["".join(x) for x in itertools.batched(text, size)]


def material_chunks(text: str, most: int) -> list[str]:
    """A digest's source text, whole if it fits, else packed by its numbered materials, which begin at a line of their own."""
    if len(text) <= most:
        return [text]
    starts = [m.start() for m in re.finditer("^## 材料 [0-9]+:", text, re.MULTILINE) if m.start()]
    return packed([text[i:j] for i, j in zip([0, *starts], [*(s - 1 for s in starts), len(text)])], most)


def newline_chunks(text: str, most: int) -> list[str]:
    """Chunks of at most ``most`` characters, trimmed, that end before the last line break if it lies past half; blank ones go."""
    if len(text) <= most:
        return [text]
    breaks = [m.start() for m in re.finditer("\n", text)]

    def following(at: int) -> int:
        """Where the chunk from ``at`` ends."""
        if at + most >= len(text):
            return len(text)
        before = bisect.bisect_left(breaks, at + most)
        return breaks[before - 1] if before and breaks[before - 1] - at > most // 2 else at + most

    bounds = [0]
    while bounds[-1] < len(text):
        bounds.append(following(bounds[-1]))
    return [c for c in (text[i:j].strip() for i, j in itertools.pairwise(bounds)) if c]


def mapped(f, kind: str):
    """An Arrow UDF of a function of one string."""

    def column(c: Column, *args) -> Column:
        @F.arrow_udf(kind)
        def apply(texts: pa.Array) -> pa.Array:
            return pa.array([f(t.as_py(), *args) if t.is_valid else None for t in texts], pa.list_(pa.string()) if kind.startswith("array") else pa.string())

        return apply(c)

    return column


html_to_markdown = mapped(to_markdown, "string")
bold_normalised = mapped(normal_bold, "string")
newline_chunked = mapped(newline_chunks, "array<string>")
paragraphs_packed = mapped(lambda t, most: packed([p for p in re.split(r"\n+", t) if p], most), "array<string>")
materials_packed = mapped(material_chunks, "array<string>")


def width_of(text: str) -> int:
    """Columns that a terminal needs: two for wide characters, none for combining ones and colour codes."""
    shown = re.sub(r"\x1b\[[0-9;?]*[A-Za-z]", "", text)
    return sum(2 if unicodedata.east_asian_width(c) in "FW" else 1 for c in shown if not unicodedata.combining(c))


def display_width(c: Column) -> Column:
    @F.arrow_udf("long")
    def widths(texts: pa.Array) -> pa.Array:
        return pa.array([width_of(t.as_py()) if t.is_valid else None for t in texts], pa.int64())

    return widths(c)

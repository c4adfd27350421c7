"""Web pages as rows of nodes, by one balanced scan: what is left open is closed where the element around it ends."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: page: the caller's key; node: number in the order of the page; last: that of the last node inside (itself without any); tag: '' for text;
#: nth: the how manieth of its tag among its siblings, from 1; path: its ancestors from the outermost on (link: leads()).
STEP = "array<struct<node: int, tag: string, nth: int, link: boolean>>"
NODES = f"page string, node int, last int, tag string, text string, attributes map<string, string>, nth int, path {STEP}"


def leads(tag: str, attributes: dict[str, str]) -> bool:
    """An anchor to another place, or a frame that holds a video."""
    if tag == "iframe":
        return any(x in attributes.get("src", "").lower() for x in ("video", "player"))
    href = attributes.get("href", "")
    return tag == "a" and href != "" and not href.startswith("#")


REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(;?)")


class Scan(HTMLParser):
    """ended: only references that end in a semicolon are decoded; HTML has old names and numbers that need none."""

    def __init__(self, ended: bool = False):
        super().__init__(convert_charrefs=True)
        self.ended = ended
        #: A character that the page doesn't have, in place of the sign before what is no reference; '' without such.
        self.sign = ""
        self.nodes: list[list] = []
        self.open: list[list] = []
        #: Fields of STEP, outermost first.
        self.path: list[tuple] = []
        self.children: list[dict[str, int]] = [{}]
        self.apart = True

    def take(self, html: str) -> list[list]:
        if self.ended and "&" in html:
            self.sign = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
            html = REFERENCE.sub(lambda m: m[0] if m[2] and (m[1][0] == "#" or m[1] + ";" in html5) else self.sign + m[0][1:], html)
        self.feed(html)
        self.close()
        return self.all()

    def plain(self, x: str | None) -> str:
        return x.replace(self.sign, "&") if x and self.sign else x or ""

    def add(self, tag: str, text: str | None, attributes: dict[str, str]) -> list:
        among = self.children[-1]
        among[tag] = among.get(tag, 0) + 1
        row = [len(self.nodes), len(self.nodes), tag, text, attributes, among[tag], list(self.path)]
        self.nodes.append(row)
        self.apart = True
        return row

    def handle_starttag(self, tag, attrs):
        row = self.add(tag, None, {self.plain(k): self.plain(v) for k, v in attrs})
        if tag not in VOID:
            self.open.append(row)
            self.path.append((row[0], tag, row[5], leads(tag, row[4])))
            self.children.append({})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_one()

    def close_one(self):
        self.open.pop()[1] = len(self.nodes) - 1
        self.path.pop()
        self.children.pop()
        self.apart = True

    def handle_endtag(self, tag):
        if any(x[2] == tag for x in self.open):
            while self.open[-1][2] != tag:
                self.close_one()
            self.close_one()

    def handle_data(self, data):
        data = self.plain(data)
        if self.apart:
            self.add("", data, {})
            self.apart = False
        else:
            self.nodes[-1][3] += data

    def handle_comment(self, data):
        self.apart = True

    def unknown_decl(self, data):
        self.apart = True

    def all(self) -> list[list]:
        while self.open:
            self.close_one()
        return self.nodes


def page_nodes(pages: DataFrame, page: str, html: str, ended: bool = False) -> DataFrame:
    """NODES of pages (page: any type that casts to a string, one row a page). Null and empty pages have no nodes; comments are none.

    ended: character references without a semicolon stay as they are.
    """
    names = ["page", "node", "last", "tag", "text", "attributes", "nth", "path"]
    step = pa.struct([("node", pa.int32()), ("tag", pa.string()), ("nth", pa.int32()), ("link", pa.bool_())])
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32()]

    def paths(found: list[list]) -> pa.Array:
        # Column by column: Arrow takes a struct's fields several times as fast as records of them.
        fields = list(zip(*itertools.chain.from_iterable(found))) or [()] * len(step)
        ends = pa.array(itertools.accumulate(map(len, found), initial=0), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(fields, step)], fields=list(step)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                found = Scan(ended).take(text.as_py())
                for i in range(0, len(found), 2000):
                    columns = list(zip(*found[i : i + 2000]))
                    columns[4] = [list(x.items()) for x in columns[4]]
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(columns[0])), *[pa.array(c, t) for c, t in zip(columns, kinds)], paths(columns[6])], names)

    given = pages.select(F.col(page).cast("string").alias("page"), F.col(html).alias("html")).filter("html is not null")
    return given.mapInArrow(rows, NODES)


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col("attributes")["class"], F.lit("")), r"\s+"), name)


def with_text(tag: str = "") -> Column:
    """Text nodes that readers see: not those of scripts and styles."""
    return (F.col("tag") == tag) & ~F.exists("path", lambda x: x["tag"].isin("script", "style", "template"))

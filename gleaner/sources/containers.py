"""Word containers (.docx) as rows: zip members are read as streams and pull-parsed, a paragraph or a table's row at a time."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: part: title, style, number, level, paragraph, run, cell or error; which of the other columns it fills, word_parts() says.
PARTS = (
    "path string, part string, block int, row int, cell int, run int, text string, bold boolean, italic boolean, strike boolean, "
    "color string, style string, list string, level int, direct boolean, span int, merged boolean"
)
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TITLE = "{http://purl.org/dc/elements/1.1/}title"
VAL, BOLD, ITALIC, STRIKE, COLOR, STYLE, LIST, LEVEL = (WORD + x for x in ("val", "b", "i", "strike", "color", "pStyle", "numId", "ilvl"))
PARAGRAPH, RUN, LINK, TEXT, BREAK, TABLE, ROW = (WORD + x for x in ("p", "r", "hyperlink", "t", "br", "tbl", "tr"))
ABOUT_PARAGRAPH, ABOUT_RUN, ABOUT_LIST = (WORD + x for x in ("pPr", "rPr", "numPr"))
#: What stands for a character inside a run.
SIGNS = {WORD + "tab": "\t", WORD + "ptab": "\t", WORD + "cr": "\n", WORD + "noBreakHyphen": "-"}


def value(element, *path: str) -> str | None:
    """The w:val of a descendant by names."""
    found = None if element is None else element.find("/".join(WORD + p for p in path))
    return None if found is None else found.get(WORD + "val", "")


def values(element) -> dict[str, str]:
    """The w:val of each of an element's children by tag, the first of equal ones: one pass in place of a search for each name."""
    return {} if element is None else {x.tag: x.get(VAL, "") for x in reversed(element)}


def is_on(said: dict[str, str], name: str) -> bool:
    return said.get(name, "0") not in ("0", "false", "off")


def number(text: str | None) -> int:
    return int(text) if (text or "").isdigit() else 0


def run_text(run) -> str:
    out = []
    for x in run:
        if x.tag == TEXT:
            out.append(x.text or "")
        elif x.tag == BREAK:
            out.append("\n" if x.get(WORD + "type", "textWrapping") == "textWrapping" else "")
        else:
            out.append(SIGNS.get(x.tag, ""))
    return "".join(out)


def runs_of(paragraph) -> Iterator[tuple]:
    """A paragraph's runs, in order: the run, and whether it is the paragraph's own (not inside a link)."""
    for x in paragraph:
        if x.tag == RUN:
            yield x, True
        elif x.tag == LINK:
            yield from ((r, False) for r in x.findall(RUN))


def paragraph_rows(paragraph, block: int) -> Iterator[dict]:
    about = paragraph.find(ABOUT_PARAGRAPH)
    listed = values(None if about is None else about.find(ABOUT_LIST))
    yield {"part": "paragraph", "block": block, "style": values(about).get(STYLE), "list": listed.get(LIST), "level": number(listed.get(LEVEL))}
    for i, (run, direct) in enumerate(runs_of(paragraph)):
        marks = values(run.find(ABOUT_RUN))
        color = marks.get(COLOR)
        yield {
            "part": "run", "block": block, "run": i, "text": run_text(run), "direct": direct, "bold": is_on(marks, BOLD), "italic": is_on(marks, ITALIC),
            "strike": is_on(marks, STRIKE), "color": color.upper() if color and color != "auto" else None,
        }


def cell_rows(row, block: int, at: int) -> Iterator[dict]:
    column = 0
    for cell in row.findall(WORD + "tc"):
        about = cell.find(WORD + "tcPr")
        span = number(value(about, "gridSpan")) or 1
        merge = None if about is None else about.find(WORD + "vMerge")
        text = "\n".join("".join(run_text(r) for r, _ in runs_of(p)) for p in cell.findall(WORD + "p"))
        yield {"part": "cell", "block": block, "row": at, "cell": column, "span": span, "text": text, "merged": merge is not None and merge.get(WORD + "val") != "restart"}
        column += span


def body_rows(stream) -> Iterator[dict]:
    """The blocks of the body: paragraphs with their runs, and tables' cells. What has been read is let go at once."""
    # The document, its body and the body's present block; deeper elements are only counted.
    around, depth, block, rows = [None] * 3, 0, -1, 0
    for event, x in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            if depth < 3:
                around[depth] = x
            depth += 1
            if depth == 3 and x.tag in (PARAGRAPH, TABLE):
                block, rows = block + 1, 0
            continue
        depth -= 1
        if depth == 2:
            if x.tag == PARAGRAPH:
                yield from paragraph_rows(x, block)
            around[1].remove(x)
        elif depth == 3 and x.tag == ROW:
            if around[2].tag == TABLE:
                yield from cell_rows(x, block, rows)
                rows += 1
            around[2].remove(x)


def style_rows(stream) -> Iterator[dict]:
    for _, x in ElementTree.iterparse(stream):
        if x.tag == WORD + "style":
            named = {"part": "style", "text": value(x, "name")}
            yield {**named, "style": x.get(WORD + "styleId")}
            if x.get(WORD + "type") == "paragraph" and x.get(WORD + "default") in ("1", "true", "on"):
                yield {**named, "style": None}
            x.clear()


def numbering_rows(stream) -> Iterator[dict]:
    at = 0
    for _, x in ElementTree.iterparse(stream):
        if x.tag == WORD + "abstractNum":
            for level in x.findall(WORD + "lvl"):
                yield {"part": "level", "list": x.get(WORD + "abstractNumId"), "level": number(level.get(WORD + "ilvl")), "text": value(level, "numFmt"), "block": at}
                at += 1
            x.clear()
        elif x.tag == WORD + "num":
            yield {"part": "number", "list": x.get(WORD + "numId"), "text": value(x, "abstractNumId")}


def title_rows(stream) -> Iterator[dict]:
    for _, x in ElementTree.iterparse(stream):
        if x.tag == TITLE:
            yield {"part": "title", "text": (x.text or "").strip()}


MEMBERS = (("docProps/core.xml", title_rows), ("word/styles.xml", style_rows), ("word/numbering.xml", numbering_rows), ("word/document.xml", body_rows))


def container_rows(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as members:
        names = set(members.namelist())
        for name, read in MEMBERS:
            if name in names:
                with members.open(name) as stream:
                    yield from read(stream)
            elif read is body_rows:
                yield {"part": "error", "text": f"no {name}"}


def word_parts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """PARTS of Word containers. path: any type that casts to a string, one row a path; content: the bytes.

    title: text; style: style (null: the default one of paragraphs) and its name, text; number: list and its abstract list, text; level:
    abstract list, level, format as text, block as position; paragraph: block, style, list, level; run: block, run, text, marks, direct;
    cell: block, row, cell (its first column), span, text, merged with what is above. A container that can't be read, or only in part, has an
    error row beside what was read; a null one gives none.
    """
    fields = [f.split() for f in PARTS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    names = [name for name, _ in fields[1:]]

    def read(blob: bytes) -> Iterator[dict]:
        try:
            yield from container_rows(blob)
        except (zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError, OSError, EOFError, ValueError) as e:
            yield {"part": "error", "text": type(e).__name__}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1)):
                found = read(blob.as_py())
                while part := list(itertools.islice(found, 4000)):
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(part)), *[pa.array([r.get(n) for r in part], schema.field(n).type) for n in names]], schema=schema)

    given = files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).filter("content is not null")
    return given.mapInArrow(rows, PARTS)


def packed_members(*members: tuple[str, Column]) -> Column:
    """A container's bytes from names and texts of its members: the way back, for exports and tests."""
    names = [name for name, _ in members]

    @F.arrow_udf("binary")
    def packed(*texts: pa.Array) -> pa.Array:
        out = []
        for row in zip(*texts):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for name, x in zip(names, row):
                    if x.is_valid:
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), x.as_py())
            out.append(held.getvalue())
        return pa.array(out, pa.binary())

    return packed(*[c for _, c in members])

"""Texts cut and wrapped to columns of a terminal: wide characters take two, colour codes none."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]")
#: No character before this one is wide.
FIRST_WIDE = 0x1100


@functools.cache
def columns() -> np.ndarray:
    """Columns of all characters by number."""
    return np.fromiter((2 if unicodedata.east_asian_width(chr(i)) in "FW" else 1 for i in range(0x110000)), np.int8, 0x110000)


def measured(text: str) -> np.ndarray:
    """Columns used before each character, and the total at the end; those of a colour code use none."""
    numbers = np.frombuffer(text.encode("utf-32-le"), "<u4")
    used = np.zeros(len(numbers) + 1, np.int64)
    if len(numbers):
        widths = columns()[numbers] if numbers.max() >= FIRST_WIDE else np.ones(len(numbers), np.int8)
        if "\x1b" in text:
            for code in CODE.finditer(text):
                widths[code.start() : code.end()] = 0
        np.cumsum(widths, out=used[1:])
    return used


def end_of(used: np.ndarray, start: int, room: int) -> int:
    """Where a line from ``start`` ends: as many characters as there is room for, one at least, and the codes after the last one."""
    end = int(np.searchsorted(used, used[start] + max(room, 0), "right")) - 1
    if used[end] == used[start] and end < len(used) - 1:
        end = int(np.searchsorted(used, used[end + 1], "right")) - 1
    return end


def wrap(text: str, width: int, prefix: str) -> list[str]:
    used, room = measured(text), width - int(measured(prefix)[-1])
    end = end_of(used, 0, width)
    lines = [text[:end]]
    while end < len(text):
        start, end = end, end_of(used, end, room)
        lines.append(prefix + text[start:end])
    return lines


def fit(text: str, width: int) -> str:
    used = measured(text)
    if used[-1] <= width:
        return text + " " * (width - int(used[-1]))
    if width < 1:
        return ""
    end = int(np.searchsorted(used, width - 1, "right")) - 1
    return text[:end] + "…" + " " * (width - 1 - int(used[end]))


def wrapped(c: Column, width: int, prefix: str = "") -> Column:
    """An array of lines of up to ``width`` columns, the later ones with a prefix, whose columns count; a line has a character at least.

    Line feeds are characters like others. An empty text is one empty line, null is null.
    """

    @F.arrow_udf("array<string>")
    def lines(texts: pa.Array) -> pa.Array:
        return pa.array([wrap(t.as_py(), width, prefix) if t.is_valid else None for t in texts], pa.list_(pa.string()))

    return lines(c)


def fitted(c: Column, width: int) -> Column:
    """The text in exactly ``width`` columns: padded with blanks, or cut, with an ellipsis at its end. Null is null."""

    @F.arrow_udf("string")
    def texts_of(texts: pa.Array) -> pa.Array:
        return pa.array([fit(t.as_py(), width) if t.is_valid else None for t in texts], pa.string())

    return texts_of(c)

"""Kinds and sizes of images by their headers, from a binary column, without an image library.

PNG, GIF and WebP have their sizes at fixed places, which columns read; a JPEG's segments must be walked, so only JPEGs go to Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest width, height and, where no size can be read, number of bytes of an image worth keeping. Fixed values.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_BYTES = 100, 100, 5000


def number(content: Column, at: int, n: int, little: bool = False) -> Column:
    """n bytes from position ``at`` (0 is the first) as a number; null where they end before."""
    picked = [F.hex(F.substring(content, at + 1 + i, 1)) for i in range(n)]
    digits = F.concat(*(picked[::-1] if little else picked))
    return F.when(F.length(content) >= at + n, F.conv(digits, 16, 10).cast("long"))


def has(content: Column, at: int, digits: str) -> Column:
    return F.hex(F.substring(content, at + 1, len(digits) // 2)) == digits


def walk(blob: bytes) -> list[int] | None:
    """Width and height in a JPEG's first frame header; None where it has none, or is cut off before."""
    at, end = 2, len(blob)
    while at + 1 < end and blob[at] == 0xFF:
        mark = blob[at + 1]
        if mark == 0xFF:  # a fill byte
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:  # no length follows
            at += 2
        elif mark in (0xD9, 0xDA):  # the end, or pixels
            return None
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return [int.from_bytes(blob[at + 7 : at + 9], "big"), int.from_bytes(blob[at + 5 : at + 7], "big")] if at + 9 <= end else None
        else:
            length = int.from_bytes(blob[at + 2 : at + 4], "big")
            if length < 2:
                return None
            at += 2 + length
    return None


def jpeg_size(content: Column) -> Column:
    @F.arrow_udf("array<long>")
    def sizes(blobs: pa.Array) -> pa.Array:
        return pa.array([walk(b.as_py()) if b.is_valid else None for b in blobs], pa.list_(pa.int64()))

    return sizes(content)


def image_kind(content: Column) -> Column:
    """png, gif, jpeg or webp by the first bytes; null for others and for null."""
    webp = has(content, 0, "52494646") & has(content, 8, "57454250")
    gif = has(content, 0, "474946383761") | has(content, 0, "474946383961")
    return F.when(has(content, 0, "89504E470D0A1A0A"), "png").when(gif, "gif").when(has(content, 0, "FFD8FF"), "jpeg").when(webp, "webp")


def image_size(content: Column) -> Column:
    """a struct (width, height) of longs, from the header; both null for cut off headers, other kinds and null."""
    kind = image_kind(content)
    jpeg = jpeg_size(F.when(kind == "jpeg", content))
    bits = number(content, 21, 4, little=True)
    lossy, lossless, extended = (has(content, 12, x) for x in ("56503820", "5650384C", "56503858"))

    def side(png: int, gif: int, place: int, first: int, frame: int, canvas: int) -> Column:
        low = F.when(has(content, 23, "9D012A"), number(content, frame, 2, little=True).bitwiseAND(0x3FFF))
        packed = F.when(has(content, 20, "2F"), F.shiftright(bits, first).bitwiseAND(0x3FFF) + 1)
        webp = F.when(lossy, low).when(lossless, packed).when(extended, number(content, canvas, 3, little=True) + 1)
        at_place = F.when(has(content, 12, "49484452"), number(content, png, 4))
        return F.when(kind == "png", at_place).when(kind == "gif", number(content, gif, 2, little=True)).when(kind == "jpeg", F.get(jpeg, F.lit(place))).when(kind == "webp", webp)

    return F.struct(side(16, 6, 0, 0, 26, 24).alias("width"), side(20, 8, 1, 14, 28, 27).alias("height"))


def image_ok(content: Column, size: Column, least_width: int = LEAST_WIDTH, least_height: int = LEAST_HEIGHT, least_bytes: int = LEAST_BYTES) -> Column:
    """large enough by its size (image_size()); where that is unknown or zero, by its bytes. Null content is not."""
    width, height = size["width"], size["height"]
    known = (width > 0) & (height > 0)
    return F.coalesce(F.when(known, (width >= least_width) & (height >= least_height)).otherwise(F.length(content) >= least_bytes), F.lit(False))

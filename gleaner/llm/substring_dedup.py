"""Operator 4: duplicated passages by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is reference for those with larger ids. Its text is cut, by content alone, into blocks: runs of consecutive WINDOW-word
windows that have the same anchor, the smallest hash among the GRAM-word grams of the window; so two documents that share a passage cut it
into the same blocks wherever it stands. All blocks go into an index with their smallest doc_id and their place in it. Blocks of a document
that the index has with a smaller id are matches. Where a passage ends, a block matches in part only: its anchor is known, its content is
not. Those boundary blocks, and the reference blocks with their anchors, are opened, and their windows are looked up one by one, as further
matches. The document is then parsed greedily: matches that go on in the same reference at the same distance are one, as long as it goes, and
from each place on the match that reaches furthest becomes the next factor (its words, the reference, the place there). The matches are at
least WINDOW words long by construction, so the words of all factors are the duplicate spans.

That is exact: windows with equal words have equal anchors, so a window can only repeat in a block with its anchor; equal blocks have equal
windows; and blocks that are alone with their anchor hold no repeated window. It never pairs documents: a passage in n documents costs n rows
in each step. Hashes that decide are 128 bits wide. Shuffled are thin rows (a block is about 20 words) and, for the two steps that need words
again, the texts by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import written

WINDOW, GRAM = 50, 8
#: Windows in a block at most: its first and last one then cover it.
MOST = WINDOW - GRAM + 1
#: Stands for a null doc_id: no reference for others.
HIGHEST = (1 << 63) - 1
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


def joined(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of sequences from those of their two parts."""
    return mixed(a * ODD[lane] + b)


def grams(words: np.ndarray, size: int, lane: int) -> np.ndarray:
    """The hash of each run of ``size`` words, put together from runs of powers of two."""
    power, made, out = words, 1, None
    have = 0
    while True:
        if size & made:
            n = len(words) - have - made + 1
            out = power[:n] if out is None else joined(out[:n], power[have : have + n], lane)
            have += made
        if have == size:
            return out
        power = joined(power[:-made], power[made:], lane)
        made *= 2


class Passages:
    """A text's words and the hashes of its windows; empty if it has no window."""

    def __init__(self, text: bytes):
        self.words = text.split()
        n = len(self.words) - WINDOW + 1
        self.windows = max(n, 0)
        if n < 1:
            return
        base = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.hash = [grams(mixed(base + ODD[lane]), WINDOW, lane).view(np.int64) for lane in (0, 1)]
        self.base = base

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor, first window, number of windows of each block."""
        gram = grams(mixed(self.base + ODD[0]), GRAM, 0)
        low, width = gram, 1
        while width * 2 <= MOST:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < MOST:
            low = np.minimum(low[: len(low) - (MOST - width)], low[MOST - width :])
        begins = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=begins[1:])
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(low)))
        if size.max() > MOST:  # repetitive text
            more = [(f + i, min(MOST, s - i)) for f, s in zip(first.tolist(), size.tolist()) for i in range(0, s, MOST)]
            first, size = (np.array(x) for x in zip(*more))
        return low[first].view(np.int64), first, size


#: Columns that name a document: its id, and a hash of its text for rows that repeat an id.
DOC = "doc long, mark long"
BLOCK = f"{DOC}, anchor long, one long, two long, first int, windows int"
BATCH = 200_000


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text) to blocks, with the 128-bit hash (one, two) of their content."""
    names = ["doc", "mark", "anchor", "one", "two", "first", "windows"]
    kept: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            p = Passages(text.as_py())
            if not p.windows:
                continue
            anchor, first, size = p.blocks()
            last = first + size - 1
            content = [(joined(h[first].view(np.uint64), h[last].view(np.uint64), i) + size.astype(np.uint64)).view(np.int64) for i, h in enumerate(p.hash)]
            kept.append([np.full(len(first), doc), np.full(len(first), mark), anchor, *content, first.astype(np.int32), size.astype(np.int32)])
            held += len(first)
            if held >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], names)
                kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], names)


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text, opened blocks) to the windows of those blocks."""
    names = ["doc", "mark", "at", "one", "two"]
    kept: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        for doc, mark, text, opened in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            p = Passages(text.as_py())
            at = np.concatenate([np.arange(b["first"], b["first"] + b["windows"]) for b in opened])
            kept.append([np.full(len(at), doc), np.full(len(at), mark), at.astype(np.int32), p.hash[0][at], p.hash[1][at]])
            held += len(at)
            if held >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], names)
                kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], names)


Match = tuple[int, int, int, int]


def longest(matches: list[Match]) -> list[Match]:
    """Matches (a, b, ref, at: words a to b, exclusive, are those of document ref from at on), those that go on in one reference as one."""
    out: list[Match] = []
    for a, b, ref, at in sorted(matches, key=lambda m: (m[2], m[3] - m[0], m[0])):
        if out and out[-1][2] == ref and out[-1][3] - out[-1][0] == at - a and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), ref, out[-1][3])
        else:
            out.append((a, b, ref, at))
    return sorted(out)


def factors_of(matches: list[Match]) -> list[Match]:
    """The greedy parse: from each place that a match covers, the one that reaches furthest (of several, that of the smallest reference)."""
    found = longest(matches)
    out: list[Match] = []
    place, i, best = 0, 0, None
    while True:
        while i < len(found) and found[i][0] <= place:
            if best is None or (found[i][1], -found[i][2]) > (best[1], -best[2]):
                best = found[i]
            i += 1
        if best is not None and best[1] > place:
            out.append((place, best[1], best[2], best[3] + place - best[0]))
            place = best[1]
        elif i < len(found):
            place, best = found[i][0], None
        else:
            return out


FACTOR = "a: int, b: int, ref: long, at: int"


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, matches) to doc_id, n_words, n_removed, kept_sha256 and factors."""
    names = ("a", "b", "ref", "at")
    factor = pa.struct([(n, pa.int64() if n == "ref" else pa.int32()) for n in names])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(factor)]
    for batch in batches:
        rows = []
        for doc, text, matches in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = text.as_py().split()
            factors = factors_of([tuple(m[n] for n in names) for m in matches or []])
            kept, place = [], 0
            for a, b, _, _ in factors:
                kept += words[place:a]
                place = b
            kept += words[place:]
            rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(names, f)) for f in factors]))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and factors (words removed, and where they stand before) of each row.

    Removed is each word in a window of WINDOW words that also starts in a document with a smaller doc_id. Null and empty texts have no words.
    Rows that repeat a doc_id are no reference for each other. A null doc_id is above every other. An empty table gives none; other columns
    are ignored.
    """
    content = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    texts = docs.select("doc_id", content).select("doc_id", F.coalesce("doc_id", F.lit(HIGHEST)).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    blocks = written(texts.select("doc", "mark", "text").mapInArrow(blocks_of, BLOCK))
    # The index: each block with its smallest document, each anchor with its number of blocks and smallest document.
    index = blocks.groupBy("anchor", "one", "two").agg(F.min("doc").alias("owner"), F.min_by("first", "doc").alias("there"), F.count("*").alias("n"))
    index = written(index)
    shared = index.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("owner").alias("least")).filter("kinds > 1")
    index = index.join(shared, "anchor", "left").filter("n > 1 or kinds > 1")
    # Copied blocks have a smaller owner. An owner's block is opened if its anchor has others.
    told = written(blocks.join(index, ["anchor", "one", "two"]).filter("owner < doc or kinds > 1").select("doc", "mark", "first", "windows", "owner", "there"))
    opened = told.filter("owner = doc").groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "windows")).alias("opened"))
    windows = written(texts.select("doc", "mark", "text").join(opened, ["doc", "mark"]).mapInArrow(windows_of, f"{DOC}, at int, one long, two long"))
    first = windows.groupBy("one", "two").agg(F.min("doc").alias("owner"), F.min_by("at", "doc").alias("there"), F.max("doc").alias("last")).filter("owner < last").select("one", "two", "owner", "there")
    edges = windows.join(first, ["one", "two"]).filter("owner < doc").select("doc", "mark", F.col("at").alias("a"), (F.col("at") + WINDOW).alias("b"), F.col("owner").alias("ref"), F.col("there").alias("at"))
    copies = told.filter("owner < doc").select("doc", "mark", F.col("first").alias("a"), (F.col("first") + F.col("windows") + (WINDOW - 1)).alias("b"), F.col("owner").alias("ref"), F.col("there").alias("at"))
    matches = edges.union(copies).groupBy("doc", "mark").agg(F.collect_set(F.struct("a", "b", "ref", "at")).alias("matches"))
    joined_ = texts.join(matches, ["doc", "mark"], "left").select("doc_id", "text", "matches")
    return joined_.mapInArrow(parsed, f"doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<{FACTOR}>>")

"""Operator 9: exact duplicates by Patricia-trie owners.

Full byte strings go into compressed radix tries, whose terminal nodes hold the owner and the number of rows of a text; what texts share at
their start is held once. The tries work twice. On the map side a task's copies of a text become one entry before anything is shuffled, so a
text that a third of all rows share travels about once a task; when HELD bytes are in a trie, whole subtrees are emitted until half of it is
free. Entries are then dealt to partitions by length and content hash, where they come sorted by their bytes: every subtree off the path to
the newest text is complete, and is emitted and cut off when HELD bytes are reached. So a task holds a bounded trie whatever its partition
has. Which texts are equal is decided by their bytes alone; the rows of a text then find its owner by the text's SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.components import with_groups
from gleaner.llm.shared import written

#: Bytes of text that a trie holds before it emits subtrees. BATCH: bytes of text emitted at once.
HELD, BATCH = 16 << 20, 4 << 20
#: Stands for a null doc_id, which any other outranks.
LOWEST = -(1 << 63)


class Node:
    __slots__ = ("part", "child", "owner", "rows")

    def __init__(self, part: bytes, owner: int | None = None, rows: int = 0):
        self.part, self.child, self.owner, self.rows = part, {}, owner, rows


class PatriciaTrie:
    """Byte strings with the owner (largest or smallest id) and number of rows of each."""

    def __init__(self, better=max):
        self.root, self.better = Node(b""), better

    def add(self, key: bytes, owner: int, rows: int = 1) -> bool:
        """Whether the key is new."""
        node, at = self.root, 0
        while at < len(key):
            below = node.child.get(key[at])
            if below is None:
                node.child[key[at]] = Node(key[at:] if at else key, owner, rows)
                return True
            part = below.part
            if key.startswith(part, at):
                node, at = below, at + len(part)
                continue
            same, most = 1, min(len(part), len(key) - at)
            step = most
            while step:  # the length of the common prefix, by halves
                if same + step <= most and key[at + same : at + same + step] == part[same : same + step]:
                    same += step
                else:
                    step >>= 1
            middle = Node(part[:same])
            below.part = part[same:]
            middle.child[part[same]] = below
            node.child[key[at]] = middle
            node, at = middle, at + same
        new = not node.rows
        node.owner = owner if new else self.better(node.owner, owner)
        node.rows += rows
        return new

    def items(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        """The entries of a subtree, ``before`` being the path to it; of the whole trie without a node."""
        stack = [(node or self.root, before)]
        while stack:
            node, path = stack.pop()
            path = path + node.part if path else node.part
            if node.rows:
                yield path, node.owner, node.rows
            stack += [(c, path) for c in node.child.values()]

    def cut(self, key: bytes) -> Iterator[tuple[bytes, int, int]]:
        """The entries of all subtrees off the path to ``key`` (a key of the trie), which are cut off."""
        node, at = self.root, 0
        while True:
            on = key[at] if at < len(key) else None
            for first in [c for c in node.child if c != on]:
                yield from self.items(node.child.pop(first), key[:at])
            if on is None:
                return
            node = node.child[on]
            at += len(node.part)

    def halve(self, held: int) -> Iterator[tuple[bytes, int, int]]:
        """The entries of subtrees below the root, which are cut off, until half of the ``held`` bytes of text are."""
        gone = 0
        for first in list(self.root.child):
            if 2 * gone >= held:
                return
            for entry in self.items(self.root.child.pop(first)):
                gone += len(entry[0])
                yield entry


ENTRY = "text binary, owner long, rows long"
ARROW = pa.schema([("text", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64())])


def owners(batches: Iterable[pa.RecordBatch], better, in_order: bool) -> Iterator[pa.RecordBatch]:
    """(text, owner, rows) through a trie. In order of the texts, each comes out once; else at least once."""
    trie, held = PatriciaTrie(better), 0
    out: list[tuple[bytes, int, int]] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ARROW.types)], schema=ARROW)
        out.clear()
        return made

    def entries() -> Iterator[tuple[bytes, int, int]]:
        nonlocal held
        for b in batches:
            for text, owner, rows in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                key = text.as_py()
                if not trie.add(key, owner, rows):
                    continue
                held += len(key)
                if held >= HELD:
                    for entry in trie.cut(key) if in_order else trie.halve(held):
                        held -= len(entry[0])
                        yield entry
        yield from trie.items()

    for entry in entries():
        out.append(entry)
        weight += len(entry[0]) + 50
        if weight >= BATCH:
            yield batch()
            weight = 0
    if out:
        yield batch()


def text_owners(texts: DataFrame, largest: bool = True) -> DataFrame:
    """One row per distinct text of ``texts`` (doc_id, text binary not null): text_sha (binary), keep_id, group_size."""
    better = max if largest else min
    lowest = LOWEST if largest else (1 << 63) - 1
    entries = texts.select("text", F.coalesce("doc_id", F.lit(lowest)).alias("owner"), F.lit(1).cast("long").alias("rows"))
    partial = entries.mapInArrow(lambda it: owners(it, better, False), ENTRY)
    dealt = partial.repartition(F.length("text"), F.xxhash64("text")).sortWithinPartitions("text")
    return dealt.mapInArrow(lambda it: owners(it, better, True), ENTRY).select(F.unhex(F.sha2("text", 256)).alias("text_sha"), F.when(F.col("owner") != lowest, F.col("owner")).alias("keep_id"), F.col("rows").alias("group_size"))


def exact_duplicates(docs: DataFrame, largest: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row; equal texts are those of equal bytes, null as empty.

    The row with the largest doc_id stays (``largest`` false: the smallest); of rows that repeat both the text and that doc_id, one. A null
    doc_id stays only where its text has no other. An empty table gives none; other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # The row's number tells rows apart that repeat both the text and the doc_id; it is written, so it stays the same.
    rows = written(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_sha"), F.monotonically_increasing_id().alias("row")))
    named = F.coalesce("doc_id", F.lit(LOWEST)).alias("named")
    first = rows.groupBy("text_sha", named).agg(F.min("row").alias("keep_row"))
    groups = written(text_owners(texts, largest).withColumn("named", F.coalesce("keep_id", F.lit(LOWEST))).join(first, ["text_sha", "named"]).drop("named"))
    joined = with_groups(rows, groups, "text_sha", "group_size")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("text_sha")).alias("text_sha256"))

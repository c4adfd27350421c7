"""Operator 5: BPE encoding by prefix-sharing trie traversal, and decoding.

A prefix of a word has one encoding, and its last token decides how it can go on: the last token of a longer prefix is the token that ends
there, whose start is a prefix ending in a token that stays apart from it. So the distinct words of a batch form a trie, walked depth first;
each node gets the last token of its prefix from the states of the nodes above it, once for all words that share the prefix. The tokens that end at a node come from the vocabulary's own trie with
failure links. The trie is kept as its leaves in order: words next to each other share exactly the path of their common prefix, which stays on the stack.

Nothing is shuffled: it is one map over the rows. A worker keeps encodings of at most CACHED words and PAIRS pairs of tokens.
"""

from __future__ import annotations

import functools
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from gleaner.llm.bpe_vocab import vocabulary
from gleaner.llm.token_counts import in_parts

CACHED, PAIRS = 200_000, 200_000
NEVER = 1 << 40


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TrieEncoder:
    def __init__(self, path: str):
        self.v = v = vocabulary(path)
        self.rank = {key: r for r, key in enumerate((v.left * v.size + v.right).tolist())}
        self.edges: tuple[dict, dict] = ({}, {})
        self.parts = {t: (a, b, r) for r, (a, b, t) in enumerate(zip(v.left.tolist(), v.right.tolist(), v.made.tolist()))}
        self.apart: dict[int, bool] = {}
        self.length = list(map(len, v.bytes_of))
        # The vocabulary's own trie, child[node << 8 | byte] with root 0, and its failure links: a node's longest proper suffix in the trie.
        self.child: dict[int, int] = {}
        depths, parents, bytes_, tokens = array("i", [0]), array("i", [0]), array("B", [0]), array("i", [-1])  # of each node
        for t in range(v.size):
            if t in v.special.values() or not v.bytes_of[t]:
                continue
            node = 0
            for depth, b in enumerate(v.bytes_of[t], 1):
                key = node << 8 | b
                to = self.child.get(key, 0)
                if not to:
                    to = self.child[key] = len(depths)
                    depths.append(depth)
                    parents.append(node)
                    bytes_.append(b)
                    tokens.append(-1)
                node = to
            tokens[node] = t
        self.fail = array("i", bytes(4 * len(depths)))
        #: Of each node, the (length, token) that end there, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(depths)
        for node in np.argsort(np.frombuffer(depths, np.int32), kind="stable")[1:].tolist():
            depth, t = depths[node], tokens[node]
            if depth > 1:
                self.fail[node] = self.follow(self.fail[parents[node]], bytes_[node])
            below = self.ends[self.fail[node]]
            self.ends[node] = ((depth, t), *below) if t >= 0 else below
        self.next: dict[int, int] = {}
        self.flat = np.frombuffer(b"".join(v.bytes_of), np.uint8)
        self.sizes = np.array(self.length)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}

    def follow(self, node: int, byte: int) -> int:
        """The node of the longest suffix of the node's string and the byte."""
        while True:
            to = self.child.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The symbols at one end of a token as it is built (0: left, 1: right), latest first, with the ranks that absorb and that make them."""
        known = self.edges[side].get(token)
        if known is None:
            known, until, now = [], NEVER, token
            while True:
                part = self.parts.get(now)
                if part is None:
                    known.append((now, until, -1))
                    break
                known.append((now, until, part[2]))
                now, until = part[side], part[2]
            self.edges[side][token] = known
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b, next to each other, are what merging their bytes gives: nothing merges across the boundary.

        Symbols x at the end of a and y at the start of b are neighbours from when both exist until one is absorbed. They merge in that time
        if their rank comes before x is absorbed (an equal rank goes to the left, where x is) and not after y is.
        """
        size = self.v.size
        key = a * size + b
        known = self.apart.get(key)
        if known is not None:
            return known
        xs, ys = self.edge(a, 1), self.edge(b, 0)
        rank = self.rank.get
        i = j = 0
        out = True
        while True:
            x, x_until, x_made = xs[i]
            y, y_until, y_made = ys[j]
            r = rank(x * size + y)
            if r is not None and r < x_until and r <= y_until:
                out = False
                break
            # Go back in time: undo whichever of the two was made later.
            if x_made >= y_made:
                if x_made < 0:
                    break
                i += 1
            else:
                j += 1
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[key] = out
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words in one walk through their trie."""
        length, ends, follow = self.length, self.ends, self.next
        stay_apart, apart, size = self.stay_apart, self.apart, self.v.size
        if len(follow) > PAIRS:
            follow.clear()
        last: list[int] = [-1]  # by depth: last token of the prefix
        node: list[int] = [0]  # by depth: where the vocabulary's trie stands
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            depth = 0
            for p, q in zip(before, raw):
                if p != q:
                    break
                depth += 1
            del last[depth + 1 :], node[depth + 1 :]
            at = node[depth]
            for d in range(depth + 1, len(raw) + 1):
                key = at << 8 | raw[d - 1]
                to = follow.get(key)
                if to is None:
                    to = follow[key] = self.follow(at, raw[d - 1])
                at = to
                for n, t in ends[at]:
                    if n == d or (ok := apart.get(last[d - n] * size + t)) or (ok is None and stay_apart(last[d - n], t)):
                        break
                last.append(t)
                node.append(at)
            before = raw
            ids, d = [], len(raw)
            while d:
                ids.append(last[d])
                d -= length[last[d]]
            ids.reverse()
            self.known[word] = packed(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        known = self.known
        for part in in_parts(texts):
            split = [self.v.pieces(t) for t in part]
            distinct = set().union(*(words for words, _ in split))
            new = [w for w in distinct if w not in known]
            if len(known) + len(new) > CACHED:
                known.clear()
                new = list(distinct)
            self.learn(new)
            for words, marks in split:
                codes = list(map(known.__getitem__, words))
                for at, special in reversed(marks):
                    codes.insert(at, special.to_bytes(4, "little"))
                out.append(b"".join(codes))
        return out

    def forget(self) -> None:
        """Drops what was learned from words, so that an idle worker holds the vocabulary only."""
        for learned in (self.known, self.next, self.apart):
            learned.clear()

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; bytes that are no UTF-8 become replacement characters, as the library's decoder does it."""
        t = np.frombuffer(ids, "<u4")
        n = self.sizes[t]
        end = np.cumsum(n)
        at = np.repeat(self.starts[t] - (end - n), n) + np.arange(int(n.sum()))
        return self.flat[at].tobytes().decode("utf-8", "replace")


@functools.cache
def worker_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def id_lists(codes: list[bytes]) -> pa.ListArray:
    """Packed ids as an array of lists."""
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), "<i4")))


def encoded(text: Column, path: str) -> Column:
    """Token ids of a text as array<int>; null as empty, special strings as the tokenizer's own tokens."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return id_lists(worker_encoder(path).encode([t or "" for t in texts.to_pylist()]))

    return ids(text)


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` with token_ids, n_tokens and same (whether the ids decode to the text) in place of text; columns of these names go.

    Null and empty texts have no ids and are the same; repeated rows each keep theirs; an empty table gives an empty one. A worker holds a
    batch of texts and the ids of one part of it, and forgets the words it has met when its partition ends.
    """
    kept = [f for f in docs.schema if f.name not in ("text", "token_ids", "n_tokens", "same")]
    names = [f.name for f in kept]
    made = [StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("same", BooleanType())]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            at = 0
            for part in in_parts(t.as_py() or "" for t in batch.column("text")):
                codes = encoder.encode(part)
                ids = id_lists(codes)
                same = pa.array([encoder.decode(c) == t for c, t in zip(codes, part)], pa.bool_())
                others = batch.select(names).slice(at, len(part)).columns
                yield pa.RecordBatch.from_arrays([*others, ids, ids.value_lengths().cast(pa.int64()), same], [*names, *(f.name for f in made)])
                at += len(part)
        encoder.forget()

    return docs.select(*names, "text").mapInArrow(coded, StructType([*kept, *made]))


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of token ids; null as empty."""

    @F.arrow_udf("string")
    def text(codes: pa.Array) -> pa.Array:
        encoder = worker_encoder(path)
        return pa.array([encoder.decode(c.values.to_numpy().astype("<u4").tobytes() if c.is_valid else b"") for c in codes], pa.string())

    return text(ids)


def round_trip(text: Column, path: str) -> Column:
    """Encodes and decodes a text: struct<n_tokens, ids_sha256, decoded_sha256, same>, without the ids leaving the worker."""

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string,same:boolean>")
    def both(texts: pa.Array) -> pa.Array:
        encoder = worker_encoder(path)
        rows = []
        for part in in_parts(t.as_py() or "" for t in texts):
            for t, ids in zip(part, encoder.encode(part)):
                back = encoder.decode(ids)
                rows.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(back.encode()).hexdigest(), "same": back == t})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("same", pa.bool_())]))

    return both(text)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` with their token ids in ``token_ids``; a column of that name is replaced.

    Null and empty texts have no ids; repeated rows each keep theirs; an empty table gives an empty one.
    """
    return docs.withColumn("token_ids", encoded(F.col("text"), path))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text, of each row; null and empty texts count as empty."""
    return docs.select("doc_id", round_trip(F.col("text"), path).alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")

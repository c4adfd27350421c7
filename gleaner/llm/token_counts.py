"""Operator 1: token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch lie end to end in one array of symbols. In each round every pre-token finds the lowest rank among its
neighbouring pairs (one reduceat) and all pairs of that rank merge at once, in every pre-token; those without a pair left drop out with
their number of symbols. A merge of rank r makes only pairs of ranks above r, so merging all pairs of a pre-token's lowest rank at once,
left to right without overlap, equals merging one at a time.

Nothing is shuffled: it is one map over the rows. A worker keeps counts of at most CACHED pre-tokens.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.bpe_vocab import Vocabulary, vocabulary

#: Pre-tokens whose results a worker keeps; beyond it starts anew. CHARS: text handled at once.
CACHED, CHARS = 200_000, 1_000_000
NONE = np.int64(1) << 40


class PairRanks:
    """Ranks of arrays of symbol pairs, by binary search; NONE where a pair doesn't merge."""

    def __init__(self, v: Vocabulary):
        self.v = v
        keys = v.left * v.size + v.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.v.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)


@functools.cache
def pair_ranks(path: str) -> PairRanks:
    return PairRanks(vocabulary(path))


def symbols_left(words: list[bytes], ranks: PairRanks) -> np.ndarray:
    """The number of tokens of each (non-empty) word."""
    v = ranks.v
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    word = np.arange(len(words))
    symbol = v.id_of_byte[np.frombuffer(b"".join(words), np.uint8)]

    def ends(size: np.ndarray) -> np.ndarray:
        return np.cumsum(size) - 1

    rank = np.full(len(symbol), NONE)  # of each symbol with the next
    if len(symbol) > 1:
        rank[:-1] = ranks(symbol[:-1], symbol[1:])
    rank[ends(size)] = NONE
    while len(word):
        low = np.minimum.reduceat(rank, np.cumsum(size) - size)
        done = low == NONE
        if done.any():
            out[word[done]] = size[done]
            stay = np.repeat(~done, size)
            symbol, rank, word, size, low = symbol[stay], rank[stay], word[~done], size[~done], low[~done]
            if not len(word):
                break
        hit = np.flatnonzero(rank == np.repeat(low, size))
        # In a run of one symbol neighbouring pairs overlap: from each run of hits every other one merges.
        fresh = np.empty(len(hit), bool)
        fresh[0] = True
        np.not_equal(hit[1:], hit[:-1] + 1, out=fresh[1:])
        if not fresh.all():
            begins = hit[fresh][np.cumsum(fresh) - 1]
            hit = hit[(hit - begins) % 2 == 0]
        symbol[hit] = v.made[rank[hit]]
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        owner = np.repeat(np.arange(len(word)), size)
        size = size - np.bincount(owner[hit], minlength=len(word))
        symbol, rank = symbol[keep], rank[keep]
        now = hit - np.arange(len(hit))  # where the merged symbols are now
        last = np.zeros(len(symbol), bool)
        last[ends(size)] = True
        again = np.unique(np.concatenate([now, now[now > 0] - 1]))
        rank[again] = NONE
        again = again[~last[again]]
        rank[again] = ranks(symbol[again], symbol[again + 1])
    return out


def in_parts(texts: Iterable[str], chars: int = CHARS) -> Iterator[list[str]]:
    """Runs of whole texts, of about so many characters."""
    part: list[str] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def counter(path: str):
    """A function of a list of texts that returns their numbers of tokens."""
    ranks = pair_ranks(path)
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out: list[int] = []
        for part in in_parts(texts):
            split = [ranks.v.pieces(t) for t in part]
            new = [w for w in set().union(*(words for words, _ in split)) if w not in known]
            if len(known) + len(new) > CACHED:
                known.clear()
                new = list(set().union(*(words for words, _ in split)))
            if new:
                known.update(zip(new, symbols_left([w.encode() for w in new], ranks).tolist()))
            out += [sum(map(known.__getitem__, words)) + len(marks) for words, marks in split]
        return out

    return count


@functools.cache
def worker_counter(path: str):
    return counter(path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text, null as empty, special strings as the tokenizer's own tokens."""

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(worker_counter(path)([t or "" for t in texts.to_pylist()]), pa.int64())

    return tokens(text)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row.

    Null and empty texts have 0 bytes and tokens; repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)

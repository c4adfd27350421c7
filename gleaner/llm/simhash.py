"""Operator 3: SimHash near-duplicates from a byte-position inverted index with count filtering.

Fingerprints that differ in at most 2 of 64 bits differ in at most 2 of 8 bytes, so they share at least 6 positional bytes. A plain index of
single bytes has only 2048 lists, which grow with the corpus until every list pairs everything; so a posting is not one positional byte but
GRAM of them at once: a fingerprint is posted under every choice of GRAM of its 8 bytes. Two fingerprints with m bytes in common share as
many postings as there are choices of GRAM among m, at least LEAST_SHARED if m is 6 or more. Each pair's shared postings are tallied, pairs
that reach that number are kept, and verified bit by bit. Rows of one fingerprint are one entry of the index.

Lists of more than PAIRED fingerprints are not paired, which would emit all pairs of a crowd. Fingerprints in such a list go, with each
other, through an exact linear way: each is posted under itself and its 64 one-bit neighbours; two fingerprints share such a posting exactly
if they differ in at most 2 bits (one bit: each is the other's neighbour; two: the one between), so every member links to the smallest one of
its posting. All lists that a fingerprint shares with one outside every crowd are short, so those pairs' tallies are whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.components import components, with_groups
from gleaner.llm.shared import written

BITS = 2
#: Lists of up to so many fingerprints are paired.
PAIRED = 24
#: Positional bytes of a posting, and the masks of all choices.
GRAM = 5
MASKS = [sum(0xFF << (8 * i) for i in chosen) for chosen in combinations(range(8), GRAM)]
#: The postings that fingerprints of a link share at least.
LEAST_SHARED = comb(8 - BITS, GRAM)
#: Shingles whose bits are added up at once.
CHUNK = 200_000


def simhash(text: bytes | None, size: int = 3) -> int:
    """The fingerprint of a text as an unsigned integer; 0 for a text without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the contract's white space
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    return voted(np.frombuffer(b"".join(xxhash.xxh64_digest(s, 42) for s in shingles[i : i + CHUNK]), np.uint8) for i in range(0, len(shingles), CHUNK))


def voted(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have; parts: bytes of hashes, each hash's highest first."""
    votes, n = np.zeros(64, np.int64), 0
    for part in parts:
        bits = np.unpackbits(part.reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: Column, size: int = 3) -> Column:
    """The SimHash of word shingles as a signed long."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), size) for t in texts], np.uint64).view(np.int64))

    return hashed(text.cast("binary"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """(a, b) linking the distinct fingerprints of ``prints`` (fp): all links of short lists, and of long ones links that connect the same."""
    postings = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(MASKS)])
    posted = prints.select("fp", F.explode(postings).alias("at"))
    sizes = posted.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1")
    # By sort and merge: what comes of an explode is taken for as small as the fingerprints' file, and would go through the driver.
    posted = written(posted.join(sizes.hint("merge"), "at"))
    short = posted.filter(F.col("n") <= PAIRED).select("at", "fp")
    met = short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b").hint("merge"), "at").filter("a > b")
    tally = met.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= LEAST_SHARED)
    kept = tally.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    crowd = written(posted.filter(F.col("n") > PAIRED).select("fp").distinct())
    near = crowd.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("at"))
    smallest = near.groupBy("at").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1").select("at", "low")
    # A one-bit neighbour leads back to its members: they needn't be kept with it.
    stars = smallest.select("low", F.explode(F.expr("concat(array(at), transform(sequence(0, 63), i -> at ^ shiftleft(1L, i)))")).alias("fp")).join(crowd, "fp").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return kept.union(stars).distinct()


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row: the smallest doc_id reached by links of at most 2 differing bits.

    Null, empty and white texts have fingerprint zero and link like any other. Repeated rows each give a row. A null doc_id never names a
    component unless no other is reached. An empty table gives none; other columns are ignored.
    """
    rows = written(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    linked = components(links(prints.select("fp")))
    named = linked.join(prints.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    known = linked.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    groups = prints.join(known, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n")
    return with_groups(rows, groups, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

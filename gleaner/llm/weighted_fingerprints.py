"""Operator 6 (native): document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, each with its number of occurrences. As weights are whole numbers, a word of weight n has the n elements
(word, 1) to (word, n), each with a hash for each of SAMPLES samples; the element with the least hash is the sample. It is uniform over the
weight, and consistent: an element of two texts has the same hash in both. Two texts agree in a sample with the probability of their
generalised Jaccard similarity, the sum of the words' lesser weights over that of their greater ones. The work is that of the text's words,
whose number is the sum of the weights, and no logarithm is taken, as samplers of any real weight need.

All of it is DataFrame functions. Documents are dealt to blocks of neighbouring ids once; everything after (the next document, words, weights,
samples) needs only rows of the block, so the texts are shuffled once and nothing else is. Which document follows the last one of a block is
known from the blocks' bounds, which are ids that occur: a document whose id is a bound also goes, as a guest, to the block before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import WORD, sha_longs, sha_text

SAMPLES = 64
#: Samples of a row: the code for wider rows takes long to compile.
PART = 32
#: Bits of a sample in the fingerprint: the low ones of its hash.
SIGN_BITS = 24
#: Documents of a block, about; BLOCKS bounds the list of bounds, which all tasks hold (8 bytes each). With more documents, blocks are larger.
BLOCK_ROWS, BLOCKS = 250, 400_000


def signature(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, which, word: a hash) to keys, which, part, PART samples each, and ``word``: the greatest, which is the word where there is one."""
    counted = rows.groupBy(*keys, "which", "word").agg(F.count("*").alias("weight"))
    elements = counted.select(*keys, "which", "word", F.explode(F.sequence(F.lit(1).cast("long"), "weight")).alias("nth"))
    parts = elements.select(*keys, "which", "word", "nth", F.explode(F.array(*[F.lit(j) for j in range(SAMPLES // PART)])).alias("part"))
    hashed = parts.select(*keys, "which", "part", "word", F.xxhash64("word", "nth", "part").alias("element"))
    # Spark splits the code of an aggregate, so it stays small enough to be compiled.
    return hashed.groupBy(*keys, "which", "part").agg(*[F.min(F.xxhash64(F.lit(k), "element")).alias(f"s{k}") for k in range(PART)], F.max("word").alias("word"))


def text_of(samples: list[Column]) -> Column:
    """The fingerprint as hex, SIGN_BITS a sample; all zero for a text without words."""
    low = (1 << SIGN_BITS) - 1
    return F.concat(*[F.lower(F.lpad(F.hex(F.coalesce(s.bitwiseAND(F.lit(low)), F.lit(0))), SIGN_BITS // 4, "0")) for s in samples])


def likeness(a: str, b: str) -> Column:
    """The share of samples in which two fingerprints (columns) agree; null if either is."""
    width = SIGN_BITS // 4
    same = sum(F.when(F.substring(a, 1 + width * k, width) == F.substring(b, 1 + width * k, width), 1).otherwise(0) for k in range(SAMPLES))
    return same / F.lit(float(SAMPLES))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The next document is that of descending doc_id, the first after the last; a null doc_id is the smallest, and rows that repeat one stand in
    the order of their texts. The only document is its own next. Null and empty texts have no characters and words; texts without words are
    like each other and, but for chance, like no others. An empty table gives none; other columns are ignored.
    """
    lowest = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(lowest)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n, top = rows.agg(F.count("*"), F.max("id")).first()
    if not n:
        bounds, top = [], lowest
    else:
        bounds = bounds_of(rows.select("id"), max(1, min(BLOCKS, n // BLOCK_ROWS)), top)
    # Block i has the ids above bound i - 1, up to bound i; the last one those above all bounds.
    nobody, somebody = F.lit(False), F.lit(True)
    empty = F.expr("array()")

    def places_of(number: Column) -> Column:
        own = F.array(F.struct(number.alias("block"), nobody.alias("guest"), nobody.alias("after")))
        if not bounds:
            return own
        ahead = F.array(F.struct((number + 1).alias("block"), somebody.alias("guest"), nobody.alias("after")))
        return F.concat(own, F.when(F.get(listed(bounds), number) == F.col("id"), ahead).otherwise(empty))

    places = F.flatten(F.transform(F.array(block_number(F.col("id"), bounds)), places_of))
    places = F.concat(places, F.when(F.col("id") == top, F.array(F.struct(F.lit(0).alias("block"), somebody.alias("guest"), somebody.alias("after")))).otherwise(empty))
    placed = rows.select("*", F.explode(places).alias("p")).select("doc_id", "id", "text", "p.block", "p.guest", "p.after")
    dealt = placed.repartition(1 + len(bounds) // 4, "block")
    order = Window.partitionBy("block").orderBy("after", F.desc("id"), "text")
    near = dealt.withColumn("pos", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    both = near.withColumn("edited", edited).withColumn("n_chars", size.cast("long"))
    # The document's numbers go along as sets of one "word" each: which 0 and 1 are texts, those from 2 on numbers.
    carried = [F.col("doc_id"), F.col("n_chars"), F.col("guest").cast("long"), *sha_longs(F.sha2("edited", 256))]
    keys = ["block", "pos"]
    numbers = [F.struct(F.lit(2 + i).alias("which"), F.lit(None).cast("string").alias("t"), F.array(c).alias("v")) for i, c in enumerate(carried)]
    texts = [F.struct(F.lit(i).alias("which"), F.col(c).alias("t"), F.array().cast("array<long>").alias("v")) for i, c in enumerate(("text", "edited"))]
    one = both.select(*keys, F.explode(F.array(*texts, *numbers)).alias("x")).select(*keys, "x.which", "x.t", "x.v")
    words = one.filter("which < 2").select(*keys, "which", F.explode(F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1))).alias("w")).select(*keys, "which", F.xxhash64("w").alias("word"))
    flat = words.union(one.filter("which >= 2").select(*keys, "which", F.explode("v")))
    signs = signature(flat, keys).withColumn("f", text_of([F.col(f"s{k}") for k in range(PART)]))
    none = F.lit("0" * (PART * SIGN_BITS // 4))
    part_of = lambda i, j: F.coalesce(F.max(F.when((F.col("which") == i) & (F.col("part") == j), F.col("f"))), none)
    said = [F.concat(*[part_of(i, j) for j in range(SAMPLES // PART)]).alias(c) for i, c in enumerate(("fingerprint", "edited_fingerprint"))]
    told = [F.max(F.when(F.col("which") == 2 + i, F.col("word"))).alias(c) for i, c in enumerate(("doc_id", "n_chars", "guest", "e0", "e1", "e2", "e3"))]
    by_doc = signs.groupBy(*keys).agg(*said, *told)
    following = by_doc.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("pos")))
    return following.filter("guest = 0").select(
        "doc_id", "n_chars", sha_text([F.col(f"e{i}") for i in range(4)]).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def bounds_of(ids: DataFrame, blocks: int, top: int) -> list[int]:
    """Ids that cut the table (id) into about so many blocks, ascending, without the greatest, top: percentiles of percentiles."""
    coarse = math.isqrt(blocks - 1) + 1
    fine = -(-blocks // coarse)

    def cut(parts: int) -> Column:
        return F.percentile_approx("id", [i / parts for i in range(1, parts + 1)], 100 * parts)

    outer = sorted(set(ids.agg(cut(coarse)).first()[0]))[:-1] if coarse > 1 else []
    inner = ids.groupBy(block_number(F.col("id"), outer).alias("part")).agg(cut(fine).alias("cuts"))
    return sorted({b for r in inner.collect() for b in r.cuts} - {top})


def listed(bounds: list[int]) -> Column:
    """The bounds as one array literal: written as text, as a column for each would take long to build."""
    return F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")


def block_number(id_: Column, bounds: list[int]) -> Column:
    """The number of bounds below the id, by binary search (their number is BLOCKS at most)."""
    if not bounds:
        return F.lit(0)
    low, high = F.lit(0), F.lit(len(bounds))

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.get(listed(bounds), middle) < id_
        # low = high stays: beyond the last bound there is nothing below.
        return F.when(below, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), F.least(middle, s["high"]).alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(low.alias("low"), high.alias("high")), step)
    return found["low"]

"""Near copies of a similarity of 0.8 or more: by SimHash, and for what 64 bits are too few by the same index over wider signatures.

Each text has a SimHash of its distinct shingles; operator 3's index of positional bytes finds the pairs that differ in at most 2 bits, and
these are verified on all of their shingles. But texts with a Jaccard similarity of 0.8 in five-word shingles differ in 1 to 18 of 64 SimHash
bits (measured), which leaves no byte that both must share. So beside it stands an index of the same form, with the byte positions, the tally
of shared positional bytes and the verification, over BYTES positional bytes from one-permutation minimum hashing, each of which two texts
share with the probability of their similarity. The tally only filters, with a margin; pairs that pass are verified in the same way. Lists of
this index are those of BANDS bands of three positions.

What is asked for are components, so pairs that are linked already need no look. First every entry of a list is compared with the smallest
one, which links most near copies with about a row each. What lists still hold apart is then compared in full, in tiles: a list's entries, with
their shingle hashes, are cut into blocks of about TILE hashes, and two blocks meet in one task, which keeps the components it knows, tallies
and verifies pairs of different ones, and emits only the links that join them. So no pair of a list goes unlooked at unless others link it,
and no pairs are rows; what grows with the square of a list is the number of tiles, one up to TILE hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.components import components
from gleaner.llm.shared import keeping, written

BYTES, BANDS, TILE = 256, 14, 1_000_000
BIN = BYTES.bit_length() - 1
#: By how much less than asked the tally may estimate a pair that is verified: four standard errors.
MARGIN = 0.1
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Where an empty bin looks for a value: the other bins, in an order of its own.
ELSEWHERE = np.stack([np.random.default_rng(i).permutation(BYTES) for i in range(BYTES)])
BAND_AT = np.random.default_rng(99).permutation(BYTES)[: 3 * BANDS].reshape(BANDS, 3)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: What tells the positions apart: a text of one shingle has that one hash in every bin.
PLACE = np.random.default_rng(98).integers(0, 1 << 63, BYTES).astype(np.uint64)


def hashes(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none for a text without words."""
    words = text.lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < size else list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def signature(keys: np.ndarray) -> np.ndarray:
    """A long for each position, from the distinct hashes of a text: what becomes of the smallest hash of each bin."""
    bins = (keys >> np.uint64(64 - BIN)).astype(np.int64)  # a hash's highest bits
    out = np.full(BYTES, EMPTY)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out[bins[first]] = keys[first]
    empty = np.flatnonzero(out == EMPTY)
    if len(empty):
        order = ELSEWHERE[empty]
        full = (out != EMPTY)[order]
        out[empty] = out[order[np.arange(len(empty)), full.argmax(axis=1)]]
    out = (out ^ PLACE) * ODD
    return (out ^ (out >> np.uint64(32))) * ODD


def positional(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(56)).astype(np.uint8)


def fingerprint(keys: np.ndarray) -> int:
    """The SimHash of a text as a signed long, from the distinct hashes of its shingles."""
    parts = (keys[i : i + simhash.CHUNK].astype(">u8").view(np.uint8) for i in range(0, len(keys), simhash.CHUNK))
    return simhash.signed(simhash.voted(parts))


def signed(text: Column, size: int) -> Column:
    """struct<bytes, bands, fp> of a text (binary); null without words."""

    @F.arrow_udf("struct<bytes:binary,bands:array<long>,fp:long>")
    def signatures(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            keys = hashes(t.as_py() or b"", size)
            if not len(keys):
                rows.append(None)
                continue
            mixed = signature(keys)
            bands = mixed[BAND_AT]
            bands = ((bands[:, 0] * ODD ^ bands[:, 1]) * ODD ^ bands[:, 2]) * ODD + np.arange(BANDS, dtype=np.uint64)
            rows.append({"bytes": positional(mixed).tobytes(), "bands": bands.view(np.int64).tolist(), "fp": fingerprint(keys)})
        return pa.array(rows, pa.struct([("bytes", pa.binary()), ("bands", pa.list_(pa.int64())), ("fp", pa.int64())]))

    return signatures(text)


def hashed(text: Column, size: int) -> Column:
    """The hashes of a text (binary) as array<long>."""

    @F.arrow_udf("array<long>")
    def shingled(texts: pa.Array) -> pa.Array:
        sets = [hashes(t.as_py() or b"", size).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))

    return shingled(text)


def shared_bytes(a: str, b: str) -> Column:
    """The tally: how many positional bytes two signatures share."""

    @F.arrow_udf("int")
    def tally(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), BYTES) for c in (a, b))
        return pa.array((x == y).sum(axis=1).astype(np.int32))

    return tally(a, b)


def likely_least(similarity: float) -> int:
    """The tally from which a pair is verified."""
    return int(np.ceil(BYTES * (similarity - MARGIN + (1 - similarity + MARGIN) / 256)))


def shingles_of(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(doc_id, h) of the documents in ``asked`` (doc_id)."""
    texts = keeping(docs, written(asked.distinct()), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
    # Filtered once it is written: Spark would push a filter on the hashes below the join, and hash all texts there.
    return written(texts.select("doc_id", hashed(F.col("text"), size).alias("h"))).filter(F.size("h") > 0)


def near(pairs: DataFrame, same: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b), each once, whose texts have the similarity: those whose signatures in ``same`` (one, bytes) may, by all their shingles."""
    known = same.select("one", "bytes")
    both = pairs.distinct().join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    likely = written(both.select("a", "b", shared_bytes("x", "y").alias("n"))).filter(F.col("n") >= likely_least(similarity)).select("a", "b")
    sets = shingles_of(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")), size)
    meet = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    # shared / (x + y - shared) >= similarity, with the sets' intersection written once
    enough = F.size(F.array_intersect("x", "y")) * (1 + similarity) >= (F.size("x") + F.size("y")) * similarity - 1e-6
    return meet.filter(enough).select("a", "b").distinct()


def by_simhash(same: DataFrame) -> DataFrame:
    """(a, b) of the texts in ``same`` (one, fp) that SimHash takes for near copies: those of one fingerprint, as links to the first of them,
    and the first ones of two fingerprints that operator 3's index links."""
    prints = written(same.groupBy("fp").agg(F.min("one").alias("first")))
    equal = same.join(prints, "fp").filter("one <> first").select(F.col("one").alias("a"), F.col("first").alias("b"))
    found = simhash.links(prints.select("fp")).toDF("x", "y")
    close = found.join(prints.toDF("x", "a"), "x").join(prints.toDF("y", "b"), "y").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return equal.unionByName(close)


def unlinked(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(at, one, root) of the entries in lists of ``lists`` (at, one) that hold more than one component of ``links``."""
    roots = components(links)
    rows = written(lists.join(roots.withColumnRenamed("node", "one"), "one", "left").select("at", "one", F.coalesce("root", "one").alias("root")))
    held = rows.groupBy("at").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("at")
    return written(rows.join(held, "at"))


def tile_links(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b) linking components within a tile (one, root, block, p, q, h): pairs of its two blocks, or of its one, tallied and verified."""
    one, root, block = (table.column(c).to_numpy() for c in ("one", "root", "block"))
    sets = [h.values.to_numpy().view(np.uint64) for h in table.column("h").combine_chunks()]
    sketch = np.stack([positional(signature(h)) for h in sets])
    count = np.array([len(h) for h in sets])
    across = table.column("p")[0].as_py() != table.column("q")[0].as_py()
    parent = {int(r): int(r) for r in root}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    main = np.bincount(np.unique(root, return_inverse=True)[1]).argmax()
    others = np.flatnonzero(root != np.unique(root)[main])
    least, found = likely_least(similarity), []
    for i in others.tolist():
        may = (sketch == sketch[i]).sum(axis=1) >= least
        may &= (np.minimum(count, count[i]) >= similarity * np.maximum(count, count[i]) - 1e-6) & (root != root[i])
        if across:
            may &= block != block[i]
        for j in np.flatnonzero(may).tolist():
            x, y = top(int(root[i])), top(int(root[j]))
            if x == y:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared * (1 + similarity) >= (count[i] + count[j]) * similarity - 1e-6:
                found.append((int(one[i]), int(one[j])))
                parent[max(x, y)] = min(x, y)
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def tiled(lists: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) that link what ``lists`` (at, one, root) holds apart, all pairs of a list being looked at in some tile."""
    sets = shingles_of(docs, lists.select(F.col("one").alias("doc_id")), size).withColumnRenamed("doc_id", "one")
    sized = lists.join(sets.groupBy("one").agg(F.sum(F.size("h")).alias("n")), "one")
    blocks = sized.groupBy("at").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("blocks"))
    cut = sized.join(blocks, "at").withColumn("block", F.pmod(F.xxhash64("one"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = cut.select("at", "one", "root", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return placed.join(sets, "one").groupBy("at", "p", "q").applyInArrow(lambda t: tile_links(t, similarity), "a long, b long")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents that are near copies of others: component_id is the smallest doc_id that links reach.

    Links are exact in the similarity, but for texts that share all BYTES bytes of a signature, which are taken for near copies.
    Texts without words link to none; rows of one doc_id count as one document, and those without one are left out. An empty table gives none.
    """
    named = docs.filter("doc_id is not null").select("doc_id", "text")
    signs = written(named.select("doc_id", signed(F.coalesce("text", F.lit("")).cast("binary"), size).alias("s")))
    rows = signs.filter("s is not null").select("doc_id", "s.bytes", "s.bands", "s.fp")
    same = written(rows.groupBy("bytes").agg(F.min("doc_id").alias("one"), F.first("bands").alias("bands"), F.min_by("fp", "doc_id").alias("fp")))
    copies = rows.join(same.select("bytes", "one"), "bytes").filter("doc_id <> one").select(F.col("doc_id").alias("a"), F.col("one").alias("b"))
    posted = same.select("one", F.explode("bands").alias("at"))
    low = posted.groupBy("at").agg(F.count("*").alias("n"), F.min("one").alias("low")).filter("n > 1").select("at", "low")
    lists = written(posted.join(low.hint("merge"), "at"))  # as an explode is taken for small
    stars = lists.filter("one <> low").select(F.col("one").alias("a"), F.col("low").alias("b"))
    links = written(near(stars.unionByName(by_simhash(same)), same, named, size, similarity))
    left = unlinked(lists, links)
    if left.head(1):
        links = links.union(written(tiled(left, named, size, similarity)))
    return components(links.union(copies)).toDF("doc_id", "component_id")

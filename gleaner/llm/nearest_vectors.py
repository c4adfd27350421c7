"""Operator 12: approximate nearest neighbours by collision counting.

Vectors are projected on LINES random directions (orthonormal sets, so that projections vary less than independent ones). Each shard of
at most SHARD vectors has, for each direction, its vectors in the order of that one projection. A query looks at the windows around its own
projections, of half width WIDTH times a radius; a vector in a window collides. At distance d from the query a projection differs by a normal
variable of deviation d, so a vector within the radius collides in a direction with a known probability, and misses the threshold of collisions
with a probability of some MISSED. Vectors that reach it are verified: their distance is computed from the original vectors. The radius grows
(virtual rehashing: windows grow at both ends, and only what is new is counted) until the K best verified ones lie within it, or it reaches
the query's bound.

The bound is the distance of the K-th nearest vector of a SAMPLE, so no true neighbour lies beyond it. It is fitted; the index holds every
vector. Where a sample has fewer than K candidates there is no bound, and a shard verifies all its vectors. Every shard answers every query, in
passes of about QUERIES queries that are broadcast (a bounded number of vectors); it returns its K nearest, so what is shuffled is thin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import written

#: Directions, half width of a window for radius 1, and the part of neighbours within the radius that may miss the threshold.
LINES, WIDTH, MISSED = 64, 0.7, 0.02
#: A query's radius, as shares of its bound.
RADII = (0.5, 0.65, 0.8, 0.9, 1.0)
#: Vectors of a shard, of the sample, and about the queries of a pass.
SHARD, SAMPLE, QUERIES = 16_384, 4096, 50_000


def threshold() -> int:
    """Collisions that all but MISSED of the vectors at the radius reach, of LINES independent directions."""
    p = math.erf(WIDTH / math.sqrt(2))
    below = 0.0
    for k in range(LINES + 1):
        below += math.comb(LINES, k) * p**k * (1 - p) ** (LINES - k)
        if below > MISSED:
            return k
    return LINES


@cache
def lines(size: int) -> np.ndarray:
    """LINES directions for vectors of ``size`` components: orthonormal sets, scaled so that a projection's deviation is the length."""
    rng, out = np.random.default_rng(12), []
    while sum(map(len, out)) < LINES:
        q, _ = np.linalg.qr(rng.standard_normal((size, size if size <= LINES else LINES)))
        out.append(q.T * math.sqrt(size))
    return np.concatenate(out)[:LINES]


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(vectors.astype(np.float64) - q.astype(np.float64)).sum(axis=1))


class Shard:
    """Sorted projections of some vectors of one size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        projected = vectors.astype(np.float64) @ lines(vectors.shape[1]).T
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        # Projections of equal vectors may differ by rounding.
        self.slack = 1e-9 * (1 + float(np.abs(self.sorted).max()))

    def nearest(self, own: int, q: np.ndarray, bound: float, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the k nearest found, nearest first, ties by id."""
        others = self.ids != own
        if not np.isfinite(bound):
            return self.best(np.flatnonzero(others), q, k)
        at = lines(len(q)) @ q.astype(np.float64)
        counts, low, high = np.zeros(len(self.ids), np.int64), None, None
        found, fresh, far = np.empty(0, np.int64), ~others, np.empty(0)
        for share in RADII:
            half = WIDTH * share * bound + self.slack
            left = np.array([np.searchsorted(s, a - half, "left") for s, a in zip(self.sorted, at)])
            right = np.array([np.searchsorted(s, a + half, "right") for s, a in zip(self.sorted, at)])
            if low is None:
                new = [o[i:j] for o, i, j in zip(self.order, left, right)]
            else:
                new = [p for o, i, j, x, y in zip(self.order, left, low, high, right) for p in (o[i:j], o[x:y])]
            counts += np.bincount(np.concatenate(new), minlength=len(counts))
            low, high = left, right
            more = np.flatnonzero((counts >= least) & ~fresh)
            fresh[more] = True
            found, far = np.append(found, more), np.append(far, distances(self.vectors[more], q))
            if len(far) >= k and np.partition(far, k - 1)[k - 1] <= share * bound:
                break
        return self.top(found, far, k)

    def best(self, places: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.top(places, distances(self.vectors[places], q), k)

    def top(self, places: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids[places]
        order = np.lexsort((ids, far))[:k]
        return ids[order], far[order]


def vectors_of(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, size) of the rows that take part, v in the components' own type (floats and doubles)."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & fine).withColumn("size", F.size("v"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows (Euclidean) found for each row whose id is divisible by ``every``.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of another size than
    the query's are no candidates of it, nor are rows with its id; rows that repeat id and vector are one. Ties go to the smaller id. An empty
    table gives none.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, vec_id, embedding).distinct())
    asking = rows.filter(F.col("id") % every == 0)
    sizes = [(r["size"], r["n"], r["q"]) for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()]
    schema, parts = "query_id long, vec_id long, score double", []
    for size, n, q in sorted(sizes):
        if not q:
            continue
        own = rows.filter(F.col("size") == size)
        bounded = written(with_bounds(asking.filter(F.col("size") == size), own, size, k))
        passes = -(-q // QUERIES)
        for i in range(passes):
            shared = spark.sparkContext.broadcast(packed(bounded.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i), size))
            dealt = own.select("id", "v").repartition(-(-n // SHARD) * 4 if n > SHARD else 4, "id")
            parts.append(dealt.mapInArrow(answering(shared, size, k), schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # A row that repeats an id with another vector asks for itself: what both find is one answer, the nearer.
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def packed(queries: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pass's ids, vectors and bounds: about QUERIES rows."""
    got = queries.select("id", "v", "bound").toArrow().combine_chunks()
    kind = np.float32 if pa.types.is_float32(got.schema.field("v").type.value_type) else np.float64
    flat = got.column("v").combine_chunks().flatten().to_numpy() if len(got) else np.empty(0, kind)
    return got.column("id").to_numpy(), flat.reshape(-1, size), got.column("bound").to_numpy()


def with_bounds(queries: DataFrame, rows: DataFrame, size: int, k: int) -> DataFrame:
    """(id, v, bound): the distance of the k-th nearest row of the sample, which is the same for all queries; infinite if there are fewer."""
    sample = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(SAMPLE).select("id", "v", F.lit(0.0).alias("bound"))
    shared = rows.sparkSession.sparkContext.broadcast(packed(sample, size))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, _ = shared.value
        for batch in batches:
            out = []
            for own, q in zip(batch.column(0).to_numpy(), vectors_of(batch, size)):
                far = distances(vectors[ids != own], q)
                # A little more than the distance, against rounding.
                out.append(float(np.partition(far, k - 1)[k - 1]) * (1 + 1e-12) if len(far) >= k else math.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["id", "v", "bound"])

    kind = rows.schema["v"].dataType.simpleString()
    return queries.select("id", "v").repartition("id").mapInArrow(bounds, f"id long, v {kind}, bound double")


def answering(shared, size: int, k: int):
    """The function of a task: indexes its vectors, a shard at a time, and answers all queries of the pass from each."""
    least = threshold()

    def answers(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard = Shard(ids, vectors)
        asked, near, far = [], [], []
        for own, q, bound in zip(*shared.value):
            found, score = shard.nearest(own, q, bound, k, least)
            asked.append(np.full(len(found), own))
            near.append(found)
            far.append(score)
            if len(asked) == 2000:
                yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in (asked, near, far)], ["query_id", "vec_id", "score"])
                asked, near, far = [], [], []
        if asked:
            yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in (asked, near, far)], ["query_id", "vec_id", "score"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), vectors_of(batch, size)))
            n += batch.num_rows
            if n >= SHARD:
                ids, vectors = (np.concatenate(x) for x in zip(*held))
                for i in range(0, n - n % SHARD, SHARD):
                    yield from answers(ids[i : i + SHARD], vectors[i : i + SHARD])
                held, n = [(ids[n - n % SHARD :], vectors[n - n % SHARD :])], n % SHARD
        if n:
            yield from answers(*(np.concatenate(x) for x in zip(*held)))

    return task

"""Connected components of a distributed edge table, and joins of rows with what was found for their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: orderable, not null): root is the smallest node of its component.

    Alternates large and small stars (every node links its larger, then its smaller neighbours to the smallest node it knows) until each
    component is one star; the rounds grow as the logarithm of the longest path. Each round is checkpointed in the shared folder. Minima are
    pre-aggregated, and a hub's edges lie in a plain join that adaptive execution splits. Loops and repeated edges do no harm.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        seen = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b"), F.least("a", "b"))
        seen = seen.toDF("u", "v")
        low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = seen.join(low, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while (at := state(now)) != before and at[0]:
        before = at
        now = checkpointed(star(star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


#: A group is hot if it holds this share of all rows, so there are at most as many hot groups as its inverse: small enough to broadcast.
HOT_SHARE = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with groups on ``key`` (each key of rows is in groups once; ``size``: its number of rows), in a way that no group's rows
    meet in one task: the at most HOT_SHARE groups with a thousandth of the rows or more are broadcast, the others shuffled."""
    total = rows.count()
    hot, cold = groups.filter(F.col(size) * HOT_SHARE >= total), groups.filter(F.col(size) * HOT_SHARE < total)
    tried = rows.join(F.broadcast(hot), key, "left")
    return tried.filter(F.col(size).isNotNull()).unionByName(tried.filter(F.col(size).isNull()).select(*rows.columns).join(cold, key))

"""Operator 2: mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of their id) and queued, the whole queue as often as ``repeats`` allows. Documents are served
in packets of at most PACKET words. A packet's virtual finish time is its source's words up to and with it, divided by the source's target.
All packets are range-sorted by finish time, and truncated where their words reach the total budget: what comes before is taken, the packet
there in part. All sources go ahead in step, so each is within about a packet of its target when the budget is spent. For whole documents
a document is one packet, and the one at the cut comes in if half of it fits.

The queue is thin (id, source, size): it is written once, and no text is shuffled. Running sums are taken in slices of the shuffle hash, so
that a source of any size is many groups; slices are summed per source, and only those sums (2**SLICE_BITS a source) meet. The words of each range
partition (a row each) tell in which one the budget ends; only there running sums are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import WORD, checkpointed, written

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: A source's queue has 2**SLICE_BITS slices, by the highest bits of the shuffle hash. PACKET: words served at once.
SLICE_BITS, PACKET = 10, 128


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size: one row each) with ``target``: share times all sizes, dealt by weight, at most ``repeats`` times a source's size.

    Sources take the weights in turn, by code point, null last. What a source can't take is dealt anew by weight among the others until none
    is above its bound; only three sums a round reach the driver.
    """
    # Numbers the sources: those of a range partition within it, after the (few) partitions before it.
    parts = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = 0
    offsets = []
    for part, n in sorted(parts.groupBy("part").count().collect()):  # one row a partition
        offsets.append((part, before))
        before += n
    if not offsets:
        return sources.withColumn("target", F.lit(0.0))
    offset = F.broadcast(sources.sparkSession.createDataFrame(offsets, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = (place + F.col("before")) % len(weights)
    weighed = checkpointed(parts.join(offset, "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double")))
    bound = F.col("source_size") * repeats
    budget = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level (target for a weight of one) rises until no further source is full
        capped = bound <= F.lit(level) * F.col("weight")
        got = weighed.agg(F.sum(F.when(capped, bound)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("left"), F.count(F.when(capped, 1)).alias("full")).first()
        if got["full"] == full or not got["left"]:
            break
        full, level = got["full"], (budget - (got["taken"] or 0)) / got["left"]
    return weighed.withColumn("target", F.least(bound.cast("double"), F.lit(level) * F.col("weight"))).select("source", "source_size", "target")


def queue(rows: DataFrame, sources: DataFrame, seed: int = 7) -> DataFrame:
    """rows (source, doc_id, size, and others, which stay) with source_size and target (of ``sources``, as targets() gives them), the shuffle's
    ``spot``, and ``before``: the source's words queued before the row."""
    shuffle = F.xxhash64("doc_id", F.lit(seed))
    rows = written(rows.withColumn("spot", shuffle).withColumn("slice", F.shiftright("spot", 64 - SLICE_BITS).cast("int")))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    sums = slices.join(sources, slices["source"].eqNullSafe(sources["source"])).select(slices["source"].alias("of"), F.col("slice").alias("at"), "ahead", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    ordered = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    joined = ordered.join(sums, ordered["source"].eqNullSafe(sums["of"]) & (ordered["slice"] == sums["at"]))
    return joined.withColumn("before", F.col("ahead") + F.col("inside")).drop("of", "at", "ahead", "inside", "slice")


def packets(entries: DataFrame, packet: int | None) -> DataFrame:
    """entries (size, target, source_size, before, epoch, ...) as packets: ``at`` (words of the document before it), words and finish.

    packet: None for whole documents, which then give one each, empty ones (once) too.
    """
    if packet is None:
        cut = entries.withColumn("at", F.lit(0).cast("long")).withColumn("words", F.col("size")).filter("size > 0 or epoch = 0")
    else:
        cut = entries.filter("size > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))))
        cut = cut.withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("at")))
    served = F.col("before") + F.col("epoch") * F.col("source_size") + F.col("at") + F.col("words")
    return cut.withColumn("finish", F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.lit(0.0)))


def mixed(rows: DataFrame, sources: DataFrame | None = None, repeats: int = REPEATS, whole: bool = False, **how) -> DataFrame:
    """The mix: packets of ``rows`` (source, doc_id, size, ...) in the order of their virtual finish times, truncated at the total budget.

    Adds epoch, at, finish and taken (> 0, or the row is empty, in its place before the cut).
    """
    spark = rows.sparkSession
    if sources is None:
        sources = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **how))
    budget = int((sources.agg(F.sum("target")).first()[0] or 0) + 1e-6)
    epochs = F.explode(F.array(*[F.lit(i) for i in range(repeats)]))
    served = packets(queue(rows, sources).withColumn("epoch", epochs), None if whole else PACKET).drop("before", "target", "source_size")
    order = [F.col(c) for c in ("finish", "spot", "source", "doc_id", "size", "epoch", "at", *(c for c in ("row", "mark") if c in rows.columns))]
    ranged = written(served.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    spent = 0
    for part, words in sorted(ranged.groupBy("part").agg(F.sum("words")).collect()):  # a row a partition
        if spent + words > budget:
            last = part
            break
        spent += words
    else:
        return ranged.withColumn("taken", F.col("words")).drop("part", "words")
    before = ranged.filter(F.col("part") < last).withColumn("taken", F.col("words"))
    at_cut = ranged.filter(F.col("part") == last)
    sum_to = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + spent
    if whole:
        taken = F.when(sum_to - F.col("words") / 2 <= budget, F.col("words"))
    else:
        taken = F.when(sum_to - F.col("words") < budget, F.least(F.col("words"), F.lit(budget) - (sum_to - F.col("words"))))
    at_cut = at_cut.withColumn("taken", taken).filter("taken is not null")
    return before.union(at_cut).drop("part", "words")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row: the words that the mix takes of it.

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source, the last. Rows that repeat a doc_id are rows of
    their own. If all texts are empty, so are all targets. An empty table gives none; other columns are ignored.
    """
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    sources = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    taken = mixed(rows, sources, repeats).groupBy("row").agg(F.sum("taken").alias("taken"))
    named = sources.withColumnRenamed("source", "of")
    # A row a source: broadcast if that is little; else adaptive execution splits the hot ones.
    full = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).join(taken, "row", "left")
    return full.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

"""Incremental collection: what is new for each source, bounded histories and keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.sources.readers import free_names, kept, work_folder


def take_while_unknown(items: DataFrame, source: str, order: list[Column], known: Column) -> DataFrame:
    """Of each source's items, newest first, those before the first known one. Not an anti-join: older unknown ones stay out."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("_seen", F.max(known.cast("int")).over(w)).filter("_seen = 0").drop("_seen")


def incremental_select(items: DataFrame, source: str, order: list[str], known: Column, new_cap: int = 3, known_cap: int = 10) -> DataFrame:
    """Sources without a known item give their newest ``new_cap`` items, others up to ``known_cap`` before their first known one.

    Newest is greatest in the columns ``order``. Adds pos (from 1) and is_new. What is before the first known item is what is newer than the
    newest known one, a partial maximum; and only so many rows a source and task are shuffled to be ranked.
    """
    of, top = map(free_names(items), ("of", "last"))
    last = items.filter(known).groupBy(F.col(source).alias(of)).agg(F.max(F.struct(*order)).alias(top))
    newer = items.join(last, F.col(source).eqNullSafe(F.col(of)), "left").filter(F.col(top).isNull() | (F.struct(*order) > F.col(top)))
    ranked = newer.withColumn("pos", F.row_number().over(Window.partitionBy(source).orderBy(*map(F.desc, order))).cast("long")).filter(F.col("pos") <= max(new_cap, known_cap))
    marked = ranked.withColumn("is_new", F.col(top).isNull())
    return marked.filter(F.col("pos") <= F.when(F.col("is_new"), new_cap).otherwise(known_cap)).drop(of, top)


def running_sum(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the running sum of a value within each key, in a total order, so that no key is one task, not even all rows under no key.

    Rows are range-partitioned by key and order, and written; sums of what earlier partitions have of a key (a row a key and partition) are
    added to the sums within each.
    """
    spark, own = rows.sparkSession, free_names(rows)
    held, part, total, at, so_far, inside = map(own, ("value", "part", "sum", "at", "before", "inside"))
    path = work_folder(spark)
    cut = [F.col(k).asc_nulls_first() for k in keys] + order
    rows.withColumn(held, value).repartitionByRange(*cut).withColumn(part, F.spark_partition_id()).write.mode("overwrite").parquet(path)
    parts = spark.read.parquet(path)
    sums = parts.groupBy(*keys, part).agg(F.sum(held).alias(total))
    before = F.sum(total).over(Window.partitionBy(*keys, F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(*[F.col(k).alias(own(k)) for k in keys], F.col(part).alias(at), F.coalesce(before, F.lit(0)).alias(so_far))
    within = F.sum(held).over(Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col(part) == F.col(at)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(own(k)))
    return parts.withColumn(inside, within).join(before, same).withColumn(name, F.col(so_far) + F.col(inside)).select(*rows.columns, name)


def row_numbers(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the number of each row within its key, from 1, in a total order: running_sum() of ones, for rows that are moved once only.

    Range partitions are written sorted, so a row's place there, less that of its key's first row, is its number in the partition; what
    earlier partitions have of the key is a row a key and partition, written too, so Spark knows that it is small where it is.
    """
    own = free_names(rows)
    at, part, first, count, base = map(own, ("at", "part", "first", "count", "base"))
    path = work_folder(rows.sparkSession)
    cut = [F.col(k).asc_nulls_first() for k in keys] + order
    rows.repartitionByRange(*cut).sortWithinPartitions(*cut).withColumn(at, F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    # The upper bits of such an id are the partition, the lower 33 the place in it.
    placed = rows.sparkSession.read.parquet(path).withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(*keys, part).agg(F.min(at).alias(first), F.count("*").alias(count))
    before = F.sum(count).over(Window.partitionBy(*keys, F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    bases = kept(counts.select(*[F.col(k).alias(own(f"of_{k}")) for k in keys], F.col(part).alias(own("of")), (F.col(first) - F.coalesce(before, F.lit(0)) - 1).alias(base)))
    same = F.col(part) == F.col(own("of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(own(f"of_{k}")))
    return placed.join(bases, same).withColumn(name, F.col(at) - F.col(base)).select(*rows.columns, name)


def unprocessed(items: DataFrame, history: DataFrame, key: str, per: str | None = None, most: int | None = None, order: list[Column] = ()) -> DataFrame:
    """Items whose key is not null and not in the history; the first ``most`` of each ``per``."""
    out = items.filter(F.col(key).isNotNull()).join(history.select(key).distinct(), key, "left_anti")
    return out if not most else newest(out, [per], order, most)


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int, number: str | None = None) -> DataFrame:
    """The first n rows of each key, in the given order."""
    at = free_names(rows)("n")
    out = rows.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(at) <= n)
    return out.withColumn(number, F.col(at).cast("long")).drop(at) if number else out.drop(at)


def first_of_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Each key's first row."""
    return newest(rows, keys, order, 1)


def latest_state(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Keyed upsert as an aggregate: the last values, number of transitions, first and last time. Partial maxima, no sort."""
    last = F.max(F.struct(*order, *values)).alias("_last")
    out = events.groupBy(*keys).agg(last, F.count("*").alias("transitions"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))
    return out.select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values], "transitions", "first_at", "last_at")


def pruned(state: DataFrame, age: Column, exempt: Column, most: int, order: list[Column], days: int) -> DataFrame:
    """Entries up to ``days`` old, or exempt, or undated; of those the first ``most``. Negative days turn expiry off (Q20)."""
    kept = state if days < 0 else state.filter(age.isNull() | (age <= days) | exempt)
    return kept.orderBy(*order).limit(most)


def runs(rows: DataFrame, keys: list[str], order: list[Column], label: str) -> DataFrame:
    """Numbers each key's runs of equal labels in ``run`` (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    begins = free_names(rows)("begins")
    return rows.withColumn(begins, change).withColumn("run", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop(begins)


def trailing_streak(rows: DataFrame, keys: list[str], order: str, is_hit: Column) -> DataFrame:
    """How many of a key's last rows are hits without a break, by two partial aggregates: the last miss, and the hits after it."""
    hit, last = map(free_names(rows), ("hit", "miss"))
    tagged = rows.withColumn(hit, is_hit)
    miss = tagged.groupBy(*keys).agg(F.max(F.when(~F.col(hit), F.col(order))).alias(last))
    both = tagged.join(miss, keys)
    return both.groupBy(*keys).agg(F.count(F.when(F.col(last).isNull() | (F.col(order) > F.col(last)), 1)).alias("streak"))


def cooling(rows: DataFrame, keys: list[str], order: str, ts: str, is_hit: Column, as_of: Column, least: int = 3, seconds: int = 300) -> DataFrame:
    """the trailing streak as of a time, and whether it is at least ``least`` with its last hit under ``seconds`` old."""
    past = rows.filter(F.col(ts) <= as_of)
    last = past.groupBy(*keys).agg(F.max(F.when(is_hit, F.col(ts))).alias("_last"))
    young = F.coalesce(F.col("_last") > as_of - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))
    return trailing_streak(past, keys, order, is_hit).join(last, keys).withColumn("cooling", (F.col("streak") >= least) & young).drop("_last")


def running_half(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The fold a = (a + x) / 2 in order, seeded with the first value. Ordered inside the aggregate, per (bounded) key and day."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    fold = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.try_element_at(values, F.lit(1)), lambda a, x: (a + x) / 2)
    return rows.groupBy(*keys).agg(fold.alias("half_avg"))


def first_claims(events: DataFrame, keys: list[str], period: Column, ts: str, is_success: Column) -> DataFrame:
    """The first success of each key and period; retries and later ones don't count."""
    return events.filter(is_success).withColumn("period", period).groupBy(*keys, "period").agg(F.min(ts).alias("claimed_at"), F.count("*").alias("attempts"))


def cumulative_trim(rows: DataFrame, key: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Of each key the newest rows while their sizes sum up to half of the budget."""
    return running_sum(rows, [key], order, size, "used").filter(F.col("used") <= budget // 2)


def suffixed(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Names that collide get _1, _2, … after the first."""
    at = free_names(rows)("n")
    n = F.col(at) - 1
    unique = F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string")))
    return running_sum(rows, [name], order, F.lit(1).cast("long"), at).withColumn("unique_name", unique).drop(at)


#: Bytes of phrases that are looked for in one pass over the texts.
PHRASES = 32 << 20


def containment(docs: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """The rows of docs (without text) with those of phrases that their text contains; phrases of any length but 0.

    An Aho-Corasick automaton of the phrases goes to the tasks and reads each text once: nothing is shuffled but what is found. Phrases of
    more than PHRASES bytes are looked for in as many passes as they need.
    """
    wanted = phrases.select(F.col(phrase).alias("_p")).filter("length(_p) > 0").distinct()
    total = wanted.agg(F.sum(F.octet_length("_p"))).first()[0] or 0
    passes = max(1, -(-total // PHRASES))
    kept = [f for f in docs.schema if f.name != text]
    names = [f.name for f in kept]
    found = []
    for i in range(passes):
        part = [r[0] for r in wanted.filter(F.pmod(F.xxhash64("_p"), F.lit(passes)) == i).collect()]  # PHRASES bytes, about
        sent = docs.sparkSession.sparkContext.broadcast(part)
        found.append(docs.select(*names, F.col(text).alias("_t")).mapInArrow(lambda batches, sent=sent: phrase_hits(batches, names, sent.value), StructType([*kept, StructField("_p", StringType())])))
    return reduce(DataFrame.unionByName, found).join(phrases, F.col("_p") == F.col(phrase)).drop("_p")


def phrase_hits(batches: Iterator[pa.RecordBatch], names: list[str], phrases: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (names, _t) to rows (names, _p): one for each phrase that the text contains."""
    import ahocorasick

    if not phrases:
        return
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(p, p)
    automaton.make_automaton()
    for batch in batches:
        row, hit = [], []
        for i, t in enumerate(batch.column("_t")):
            if t.is_valid:
                inside = sorted({p for _, p in automaton.iter(t.as_py())})
                row += [i] * len(inside)
                hit += inside
        others = batch.select(names).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([*others.columns, pa.array(hit, pa.string())], [*names, "_p"])

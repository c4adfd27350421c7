"""Operator 13: how far each source of a language is from the others, by a frequent-pattern tree of term rows.

A kept term's row is its nonzero counts, in the order of the sources. With a smoothed share p(count) of a source and f(p, q) of two shares,
the sum over all V terms for a pair (a, b) is taken apart, so that zero counts cost nothing:

    V f(0, 0)  +  the terms that a has, f(ca, 0) - f(0, 0)  +  the terms that b has, f(0, cb) - f(0, 0)
               +  the terms that both have, f(ca, cb) - f(ca, 0) - f(0, cb) + f(0, 0)

where f(ca, cb) stands for f of the shares of those counts. The second line comes from histograms of counts. The last one, the corrections of
pairs, comes from the tree: equal rows are one row with a multiplicity, rows are sorted over range partitions, and each task sweeps its range
as a tree whose paths share their beginnings. A node's correction with each of its ancestors is made once, times the multiplicity that went
through the node. Where a range ends, a node is two nodes with a part of the multiplicity each, which changes no sum.

All is exact: integers throughout, sums that could leave a long in Python's integers and decimals.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import FEW, small_batches, written

#: A language keeps the terms of at least so many of its documents; ranks of terms end at TOP.
LEAST_DOCS, TOP = 3, 200
#: Terms counted by a task before it hands on what it has, and pairs of nodes evaluated at once: memory, not results, depend on them.
HELD, PAIRS = 200_000, 500_000
#: Letters of ASCII, in lower case, and all other bytes that UTF-8 uses outside ASCII stay; the rest separates terms.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), partial sums."""
    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple, dict[bytes, list[int]]] = defaultdict(dict)
    size = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in held.items():
            words = list(found)
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                n, docs = ([found[w][j] for w in part] for j in (0, 1))
                columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2)):
            into = held[lang, source]
            before = len(into)
            for word, n in Counter(terms(text.as_py())).items():
                if word in into:
                    into[word][0] += n
                    into[word][1] += 1
                else:
                    into[word] = [n, 1]
            size += len(into) - before
            if size >= HELD:
                yield from handed_on()
                size = 0
    yield from handed_on()


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, at: array of (source, n) by source) of the kept terms; docs: lang, source, text, not null."""
    flat = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(counted, "lang string, source string, term binary, n long, docs long")
    # Dealt by term once; the sums by source and by term then need no other shuffle.
    sums = flat.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("at"))
    return rows.filter(F.col("docs") >= LEAST_DOCS).select("lang", F.col("term").cast("string").alias("term"), "at")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), in two steps that stay within a long up to a total of 9 * 10^13."""
    x, y = (count + 1) * 100_000, total
    return F.lit(1) + quotient(x, y) * 10_000 + quotient((x % y) * 10_000, y)


def quotient(a: Column, b: Column) -> Column:
    """Integer division (rounds to zero; both are at least 0 here)."""
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return quotient((p - q) * (p - q), q)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    x = (count + 1) * 100_000
    return 1 + x // total * 10_000 + x % total * 10_000 // total


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Corrections:
    """Sums of corrections by pair of sources, of one language."""

    def __init__(self):
        self.sums: dict[tuple[int, int], int] = defaultdict(int)
        self.sources: dict[str, int] = {}
        self.path: list[tuple] = []  # open nodes: number of the source, count, the source's total
        self.went: list[int] = []  # multiplicity that went through each
        self.nodes: list[tuple] = []  # closed nodes with ancestors
        self.combined = 0

    def insert(self, row: list[tuple], times: int) -> None:
        """The next row in order: closes the nodes that it doesn't share, and opens its own."""
        shared = 0
        while shared < min(len(row), len(self.path)) and row[shared] == self.path[shared]:
            shared += 1
        self.close(shared)
        self.path += row[shared:]
        self.went += [0] * (len(row) - shared)
        for i in range(len(row)):
            self.went[i] += times

    def close(self, depth: int) -> None:
        if len(self.path) > max(depth, 1):
            self.nodes.append((tuple(self.path), max(depth, 1), self.went[max(depth, 1) :]))
            self.combined += (len(self.path) - max(depth, 1)) * len(self.path)
            if self.combined >= PAIRS:
                self.evaluate()
        del self.path[depth:], self.went[depth:]

    def evaluate(self) -> None:
        """The corrections of all closed nodes, each with each of its ancestors."""
        if not self.nodes:
            return
        above, below, times = [], [], []
        flat = np.array([x for path, _, _ in self.nodes for x in path], np.int64)
        start = 0
        for path, first, went in self.nodes:
            for depth, n in zip(range(first, len(path)), went):
                above.append(np.arange(start, start + depth))
                below.append(start + depth)
                times.append(n)
            start += len(path)
        sizes = [len(x) for x in above]
        a, b = flat[np.concatenate(above)], np.repeat(flat[below], sizes, axis=0)
        times = np.repeat(np.array(times, np.int64), sizes)
        pa_, pb = shares(a[:, 1], a[:, 2]), shares(b[:, 1], b[:, 2])
        za, zb = shares(np.zeros_like(times), a[:, 2]), shares(np.zeros_like(times), b[:, 2])
        for x, y, p, q, zp, zq in ((a, b, pa_, pb, za, zb), (b, a, pb, pa_, zb, za)):
            self.add(x[:, 0], y[:, 0], times, distances(p, q) - distances(p, zq) - distances(zp, q) + distances(zp, zq))
        self.nodes, self.combined = [], 0

    def add(self, a: np.ndarray, b: np.ndarray, times: np.ndarray, correction: np.ndarray) -> None:
        pair = a * len(self.sources) + b
        order = np.argsort(pair, kind="stable")
        pair, times, correction = pair[order], times[order], correction[order]
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        if int(np.abs(correction).max()) * int(times.sum()) < 1 << 62:
            sums = np.add.reduceat(correction * times, starts).tolist()
        else:  # a long could overflow
            products = [c * n for c, n in zip(correction.tolist(), times.tolist())]
            sums = [sum(products[i:j]) for i, j in zip(starts, [*starts[1:], len(products)])]
        for key, s in zip(pair[starts].tolist(), sums):
            self.sums[divmod(key, len(self.sources))] += s


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, v, at: array of (source, n, total), times) to (lang, source, other, correction as text), partial sums."""
    tree, of = Corrections(), None

    def told() -> Iterator[pa.RecordBatch]:
        tree.close(0)
        tree.evaluate()
        names = list(tree.sources)
        rows = [(of, names[a], names[b], str(s)) for (a, b), s in tree.sums.items()]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[i : i + 20_000])], ["lang", "source", "other", "correction"])

    for batch in batches:
        at = batch.column(2)
        ends = at.offsets.to_numpy()
        inner = at.values.to_pylist()
        for k, (lang, v, times) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)))):
            if lang != of:
                yield from told()
                tree, of = Corrections(), lang
            for x in (row := inner[ends[k] : ends[k + 1]]):
                if x["source"] not in tree.sources:
                    tree.evaluate()  # what is pending was numbered for fewer sources
                    tree.sources[x["source"]] = len(tree.sources)
            tree.insert([(tree.sources[x["source"]], x["n"], x["total"] + v) for x in row], times)
    yield from told()


def by(rows: DataFrame, few: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join with a written table, broadcast if it is short; adaptive execution splits what is hot in the other case."""
    return rows.join(F.broadcast(few) if few.count() <= FEW else few, on, how)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank.

    Nulls in lang, source and text are empty, each row is a document, other columns are ignored. A group whose documents have no term has no
    rows of part term, and rows of part pair with every other source of its language (value 0 if the language keeps no term). An empty table
    gives none. Ties in value go by the item's bytes.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = written(term_rows(plain))
    single = rows.select("lang", F.explode("at").alias("x")).select("lang", "x.source", "x.n")
    histogram = written(single.groupBy("lang", "source", "n").agg(F.count("*").alias("times")))
    vocabulary = rows.groupBy("lang").agg(F.count("*").alias("v"))
    totals = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("all"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").join(whole, "lang", "left")
    groups = written(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all")]))
    return pair_part(rows, histogram, groups).unionByName(term_part(rows, groups))


def pair_part(rows: DataFrame, histogram: DataFrame, groups: DataFrame) -> DataFrame:
    zero, exact = F.lit(0), "decimal(38,0)"
    kept = groups.filter("v > 0").select("lang", "source", "v", (F.col("total") + F.col("v")).alias("size"))
    others = kept.select("lang", F.col("source").alias("other"), F.col("size").alias("other_size"))
    p, q = (lambda c: share(c, F.col("size"))), (lambda c: share(c, F.col("other_size")))
    nothing = distance(p(zero), q(zero))
    # What a source's own counts change for each other source, as the first and as the second of a pair.
    one = by(by(histogram, written(kept), ["lang", "source"]), written(others), "lang").filter(F.col("source") != F.col("other"))
    first = distance(p(F.col("n")), q(zero)) - nothing
    second = distance(q(zero), p(F.col("n"))) - distance(q(zero), p(zero))
    both = F.array(F.struct("source", "other", first.alias("x")), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), second.alias("x")))
    sides = one.select("lang", "times", F.explode(both).alias("e")).select("lang", "e.source", "e.other", (F.col("e.x").cast(exact) * F.col("times")).cast(exact).alias("value"))
    # Equal rows are one, with a multiplicity; then each entry gets its source's total.
    paths = written(rows.groupBy("lang", "at").agg(F.count("*").alias("times")).withColumn("path", F.monotonically_increasing_id()))
    entries = paths.filter("size(at) > 1").select("lang", "path", "times", F.explode("at").alias("x")).select("lang", "path", "times", "x.source", "x.n")
    sized = by(entries, written(kept.select("lang", "source", "v", (F.col("size") - F.col("v")).alias("total"))), ["lang", "source"])
    full = sized.groupBy("path", "lang", "v", "times").agg(F.sort_array(F.collect_list(F.struct("source", "n", "total"))).alias("at"))
    tree = written(full.select("lang", "v", "at", "times"))
    sorted_rows = tree.repartitionByRange("lang", "at").sortWithinPartitions("lang", "at")
    told = sorted_rows.mapInArrow(swept, "lang string, source string, other string, correction string")
    corrections = told.select("lang", "source", "other", F.col("correction").cast(exact).alias("value"))
    base = kept.join(others, "lang").filter(F.col("source") != F.col("other")).select("lang", "source", "other", (nothing.cast(exact) * F.col("v")).cast(exact).alias("value"))
    bare = groups.filter("v = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("other")), "lang").filter(F.col("source") != F.col("other")).withColumn("value", F.lit(0).cast(exact))
    sums = base.unionByName(bare).unionByName(sides).unionByName(corrections).groupBy("lang", "source", "other").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    return sums.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(order).alias("rank"))


def term_part(rows: DataFrame, groups: DataFrame) -> DataFrame:
    each = rows.select("lang", "term", F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("of"), F.explode("at").alias("x"))
    known = by(each.select("lang", "term", "of", "x.source", "x.n"), groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total") + F.col("v")), share(F.col("of"), F.col("all") + F.col("v"))
    more = known.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = more.withColumn("value", distance(F.col("p"), F.col("q"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

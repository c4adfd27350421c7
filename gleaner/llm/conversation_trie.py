"""Operator 11: the trie of conversation prefixes, as a burst trie.

A turn is named by a hash of its role and text, a conversation by the names of its turns in a row. Equal conversations become one suffix with
their number. At first one container, under the root, holds all suffixes. A container of more than LIMIT turns bursts: what all its suffixes
have in common becomes a chain of trie nodes (the head), and the rest goes to new containers, by the next turn's name, each under its own
head. That is a round: sizes and common beginnings are aggregates, suffixes move without their texts. When no container is too large, they are
dealt to tasks, sorted, and swept into nodes with a stack. The heads then sum up what their containers and the heads below them have, from the
last round up. A head only bursts where its suffixes part, so equal beginnings of any length cost one round.

What one task holds is a container of LIMIT turns, or a single conversation: its turns lie in one row, at 20 bytes a turn. The hash of the
members that end at a node is that of one long string, so it is made in order: ids are sorted over range partitions, joined to pieces of at
most PIECE ids there, and a node's pieces go through one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import chosen, written

#: Turns of a container that is swept by one task; a larger one bursts.
LIMIT = 4096
#: Ids joined to one piece of a hashed string.
PIECE = 20_000
#: Bytes of a name: of a turn, of a prefix.
NAME = 16
#: A conversation starts with turns of the one whose id is the hundred below, as many as its id's checksum says, less than MOST.
STEP, MOST = 100, 6
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def name_of(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c, 256), 1, 2 * NAME))


def prefix(seq: Column, turns: Column) -> Column:
    return F.substring(seq, F.lit(1), (turns * NAME).cast("int"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (the turns' names in a row), lens (code points of their texts), mark (the sequence's name)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", name_of(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("name"), F.length(text).alias("len"))
    own = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    own = written(own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")))
    bases = own.filter(F.col("conv_id") % STEP == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, MOST - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP).join(bases, "base", "left").withColumn("h", h)
    inherited = F.slice(F.coalesce("first", F.slice("t", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    turns = both.select("conv_id", F.concat(inherited, rest).alias("t"))
    seq = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["name"])), ""))
    named = turns.select("conv_id", seq.alias("seq"), F.transform("t", lambda x: x["len"]).alias("lens"))
    return named.withColumn("mark", name_of(F.col("seq")))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (mark, conv_id) to (mark, low, n, ids): runs of one mark, PIECE ids at most, joined by commas."""
    mark, ids, out = None, [], []

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("mark", pa.binary()), ("low", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]))
            out.clear()

    def close() -> None:
        if ids:
            out.append({"mark": mark, "low": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))})
            ids.clear()

    for batch in batches:
        for m, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if m != mark or len(ids) == PIECE:
                close()
                mark = m
            ids.append(i)
            yield from ready(1000)
    close()
    yield from ready(1)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (mark, low, n, ids) to (mark, low, n, ends_sha256), one row a mark."""
    mark, row, sha = None, None, None
    schema = pa.schema([("mark", pa.binary()), ("low", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["mark"] == mark:
                sha.update(b"," + r["ids"].encode())
                row["n"] += r["n"]
                continue
            if row:
                out.append(row | {"ends_sha256": sha.hexdigest()})
            mark, row, sha = r["mark"], {"mark": r["mark"], "low": r["low"], "n": r["n"]}, hashlib.sha256(r["ids"].encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if row:
        yield pa.RecordBatch.from_pylist([row | {"ends_sha256": sha.hexdigest()}], schema)


def suffixes(convs: DataFrame) -> DataFrame:
    """The distinct sequences: seq, lens, n conversations, low (the smallest), ends_sha256. convs: a written table of rebuilt()."""
    spread = convs.select("mark", "conv_id").repartitionByRange("mark", "conv_id").sortWithinPartitions("mark", "conv_id")
    joined = spread.mapInArrow(pieces, "mark binary, low long, n long, ids string")
    ends = joined.repartition("mark").sortWithinPartitions("mark", "low").mapInArrow(hashed, "mark binary, low long, n long, ends_sha256 string")
    return convs.drop("mark").join(ends.withColumnRenamed("low", "conv_id"), "conv_id").select("seq", "lens", "n", F.col("conv_id").alias("low"), "ends_sha256")


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes, sorted by container and sequence, to nodes; ``up``, the name of the head above, where the node is a container's first."""
    schema = pa.schema([*[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("up", pa.binary())])
    container, before, out = None, None, []
    stack: list[list] = []  # [conv_id, depth, n_convs, children, leaves, saved, ends, len, nodes below that wait for this conv_id]

    def close(depth: int) -> None:
        """Closes the open nodes below ``depth``; a node's children are told when their parent's smallest member is known."""
        while stack and stack[-1][1] > depth:
            node = stack.pop()
            conv, at, n, children, leaves, saved, ends, length, waiting = node
            leaves, saved = leaves or 1, saved + (n - 1) * length
            for w in waiting:
                out.append({**w, "parent_conv_id": conv})
            told = {"conv_id": conv, "depth": at, "parent_conv_id": None, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends or NOBODY, "up": None}
            if stack:
                above = stack[-1]
                above[0], above[2], above[3] = min(above[0], conv), above[2] + n, above[3] + 1
                above[4], above[5] = above[4] + leaves, above[5] + saved
                above[8].append(told)
            else:
                out.append({**told, "up": container[1]})

    for batch in batches:
        for r in batch.to_pylist():
            seq, size = r["seq"], len(r["seq"]) // NAME
            if container is None or r["head"] != container[0]:
                close(-1)
                container, before, shared = (r["head"], r["up"]), b"", r["depth"] - 1
            else:
                shared, most = r["depth"], min(len(seq), len(before)) // NAME
                while shared < most and seq[shared * NAME : (shared + 1) * NAME] == before[shared * NAME : (shared + 1) * NAME]:
                    shared += 1
                close(shared)
            for d in range(shared + 1, size + 1):
                stack.append([r["low"], d, 0, 0, 0, 0, None, r["lens"][d - 1] if d else 0, []])
            stack[-1][0], stack[-1][2], stack[-1][6] = min(stack[-1][0], r["low"]), stack[-1][2] + r["n"], r["ends_sha256"]
            before = seq
            while len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out[:5000], schema)
                del out[:5000]
    close(-1)
    for i in range(0, len(out), 5000):
        yield pa.RecordBatch.from_pylist(out[i : i + 5000], schema)


def burst(rows: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The heads of the containers ``top`` (head), and their suffixes in new containers. rows: suffixes of these containers."""
    span = rows.groupBy("head", "up", "depth").agg(F.min("seq").alias("least"), F.max("seq").alias("greatest"), F.sum("n").alias("n"), F.min("low").alias("low"))
    size = F.least(F.length("least"), F.length("greatest")) / NAME
    same = lambda i: F.substring(F.col("least"), i * NAME + 1, F.lit(NAME)) == F.substring(F.col("greatest"), i * NAME + 1, F.lit(NAME))
    places = F.when(size > F.col("depth"), F.sequence(F.col("depth"), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    # The first turn in which the least and the greatest suffix differ, so that all between them agree up to there.
    parts = F.coalesce(F.get(F.filter(places, lambda i: ~same(i)), F.lit(0)), F.greatest(size.cast("int"), F.col("depth")))
    heads = written(span.withColumn("parts", parts).withColumn("own", name_of(prefix(F.col("least"), F.col("parts")))).drop("greatest"))
    keyed = rows.drop("up", "depth").join(F.broadcast(heads.select("head", "parts", "own")) if heads.count() <= 100_000 else heads.select("head", "parts", "own"), "head")
    # The suffix that ends where the others part stays with the head; it also has the lengths of the head's turns.
    ended = keyed.filter(F.length("seq") == F.col("parts") * NAME).select("head", "ends_sha256")
    lens = keyed.groupBy("head").agg(F.min_by(F.slice("lens", F.lit(1), F.col("parts")), "low").alias("lens"))
    moved = keyed.filter(F.length("seq") > F.col("parts") * NAME)
    below = moved.select("seq", "lens", "n", "low", "ends_sha256", name_of(prefix(F.col("seq"), F.col("parts") + 1)).alias("head"), F.col("own").alias("up"), (F.col("parts") + 1).alias("depth"))
    return written(heads.drop("least").join(lens, "head").join(ended, "head", "left")), written(below)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in the order of ``turn``, a null first, equal ones in the order of a hash of role and text; null roles and texts are empty. Rows
    without a conv_id belong to no conversation and are left out; rows that repeat are turns that repeat. Other columns are ignored. An empty
    table has no conversation, so no root.
    """
    rows = suffixes(written(rebuilt(conversations.select("conv_id", "turn", "role", "text"))))
    root = name_of(F.lit(b""))
    now = written(rows.select("*", root.alias("head"), F.lit(None).cast("binary").alias("up"), F.lit(0).alias("depth")))
    resting, heads = [], []
    while True:
        sizes = now.groupBy("head").agg(F.sum(F.length("seq") / NAME - F.col("depth") + 1).alias("turns"), F.count("*").alias("suffixes"))
        large = written(sizes.filter((F.col("turns") > LIMIT) & (F.col("suffixes") > 1)).select("head"))
        if not large.head(1):
            resting.append(now)
            break
        resting.append(chosen(now, large, "head", "left_anti"))
        head, now = burst(chosen(now, large, "head", "left_semi"), large)
        heads.append(head)
    held = resting[0]
    for more in resting[1:]:
        held = held.unionByName(more)
    order = ["head", "seq"]
    nodes = held.repartition("head").sortWithinPartitions(*order).mapInArrow(swept, NODE + ", up binary")
    if not heads:
        return nodes.drop("up")
    nodes = written(nodes)
    return with_heads(nodes, heads)


def with_heads(nodes: DataFrame, heads: list[DataFrame]) -> DataFrame:
    """The nodes of containers with those of the heads; every container's first node and every head's gets its parent."""
    columns = [c.split()[0] for c in NODE.split(", ")]
    tops = nodes.filter(F.col("up").isNotNull()).select("up", "n_leaves", "saved_tokens")
    out = nodes
    for head in reversed(heads):
        below = tops.groupBy("up").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count("*").alias("children"))
        full = head.join(below.withColumnRenamed("up", "own"), "own")
        # A head is a chain of nodes from its container's depth to where the suffixes part; lens has its turns from the root on.
        chain = F.slice("lens", F.col("depth") + 1, F.greatest(F.col("parts") - F.col("depth"), F.lit(0)))
        tail = lambda d: F.aggregate(F.slice("lens", d, F.col("parts") - d + 1), F.lit(0).cast("long"), lambda s, x: s + x)
        saved = lambda d: F.col("below") + (F.col("n") - 1) * F.when(d > 0, tail(F.greatest(d, F.lit(1)))).otherwise(F.aggregate(chain, F.lit(0).cast("long"), lambda s, x: s + x))
        d, last = F.col("d"), F.col("d") == F.col("parts")
        each = full.withColumn("d", F.explode(F.sequence("depth", "parts")))
        made = each.select(
            F.col("low").alias("conv_id"), d.cast("long").alias("depth"), F.when(d > F.col("depth"), F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved(d).alias("saved_tokens"),
            F.when(last, F.coalesce("ends_sha256", F.lit(NOBODY))).otherwise(NOBODY).alias("ends_sha256"), F.when(d == F.col("depth"), F.col("up")).alias("up"),
        )
        made = written(made)
        tops = tops.unionByName(made.filter(F.col("up").isNotNull()).select("up", "n_leaves", "saved_tokens"))
        out = out.unionByName(made)
    names = heads[0].select("own", "low")
    for head in heads[1:]:
        names = names.unionByName(head.select("own", "low"))
    first = out.filter(F.col("up").isNotNull()).drop("parent_conv_id")
    parents = written(names.select(F.col("own").alias("up"), F.col("low").alias("parent_conv_id")))
    joined = first.join(F.broadcast(parents) if parents.count() <= 100_000 else parents, "up")
    return out.filter(F.col("up").isNull()).select(*columns).unionByName(joined.select(*columns))

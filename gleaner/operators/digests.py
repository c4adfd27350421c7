"""Digests: numbered materials, packed into chunks in order, and summed up in rounds until they fit.

Only lengths are gathered for a digest (8 bytes a material); texts meet in chunks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.markdown import chunk_numbers
from gleaner.functions.text import trimmed
from gleaner.operators.incremental import row_numbers
from gleaner.sources.readers import kept

#: Between two parts of a digest; the line feed at its end is where blocks part.
RULE = "\n\n---\n\n"
#: Rounds after which a summary that doesn't shorten anything is given up.
ROUNDS = 20


def materials(docs: DataFrame, key: str, order: list[str], title: Column, kind: Column, path: Column, body: Column) -> DataFrame:
    """(key, number, text): each digest's documents in order as numbered sections; a blank body is left out, its number too."""
    named = docs.select(F.col(key).alias("key"), F.struct(*order).alias("order"), title.alias("title"), kind.alias("kind"), path.alias("path"), trimmed(F.coalesce(body, F.lit(""))).alias("body"))
    numbered = row_numbers(named, ["key"], [F.col("order")], "number").filter("body <> ''")
    lines = [F.concat(F.lit("## 材料 "), F.col("number").cast("string"), F.lit(": "), F.col("title")), F.concat(F.lit("- 类型: "), F.col("kind")), F.concat(F.lit("- 文件: "), F.col("path")), F.lit(""), F.col("body")]
    return numbered.select(F.col("key").alias(key), "number", F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in lines]).alias("text"))


def blocks_of(parts: DataFrame, key: str, number: str, text: str, head: str = "") -> DataFrame:
    """(key, place, text): parts joined by RULE, parted again at the line feeds before them, and before lines that begin as ``head`` (a regex) says."""
    # Written, as Spark would otherwise move the texts by key for this join, a row a key though it is.
    last = kept(parts.groupBy(F.col(key).alias("of")).agg(F.max(number).alias("last")))
    ended = F.concat(text, F.when(F.col(number) == F.col("last"), "").otherwise(RULE[:-1]))
    joined = parts.join(last, F.col(key).eqNullSafe(F.col("of"))).select(F.col(key).alias("key"), F.col(number).cast("long").alias("number"), ended.alias("text"))
    pieces = F.split("text", rf"\n(?={head})", -1) if head else F.array("text")
    return joined.select("key", "number", F.posexplode(pieces).alias("i", "text")).select("key", F.struct("number", "i").alias("place"), "text")


def chunks_of(blocks: DataFrame, most: int) -> DataFrame:
    """(key, order, text): blocks (key, place, text) packed in order into chunks of up to ``most`` characters of blocks.

    Blocks of a chunk are joined by line feeds, and stripped; a larger block is cut into slices. Blank chunks go.
    """

    @F.arrow_udf("array<int>")
    def numbers(lengths: pa.Array) -> pa.Array:
        return pa.array([list(chunk_numbers(x.as_py(), most)) for x in lengths], pa.list_(pa.int32()))

    sizes = blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", F.length("text").alias("n")))).alias("all"))
    dealt = sizes.select("key", F.explode(F.arrays_zip("all.place", numbers(F.transform("all", lambda x: x["n"])).alias("chunk"))).alias("x")).select(F.col("key").alias("of"), F.col("x.place").alias("at"), F.col("x.chunk").alias("chunk"))
    placed = blocks.join(dealt, F.col("key").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at"))).drop("of", "at")
    slices = F.greatest(F.ceil(F.length("text") / most).cast("int"), F.lit(1))
    cut = placed.select("key", "chunk", "place", (slices > 1).alias("cut"), F.posexplode(F.transform(F.sequence(F.lit(0), slices - 1), lambda i: F.substring("text", i * most + 1, F.lit(most)))).alias("slice", "text"))
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    chunks = cut.groupBy("key", "chunk", "slice").agg(pieces.alias("text"), F.max("cut").alias("cut"))
    stripped = chunks.select("key", F.struct("chunk", "slice").alias("order"), F.when(F.col("cut"), F.col("text")).otherwise(trimmed(F.col("text"))).alias("text"))
    return stripped.filter(trimmed(F.col("text")) != "")


def packed_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """(key, number, text): chunks_of() numbered from 1."""
    return row_numbers(chunks_of(blocks, most), ["key"], [F.col("order")], "number").select("key", "number", "text")


def digested(parts: DataFrame, key: str, summary: Callable[[Column], Column], most: int = 80_000, limit: int = 120_000, head: str = r"## 材料 \d+:") -> DataFrame:
    """(key, text, rounds): the summary of each digest's parts (key, number, text).

    Parts that fit into ``limit`` characters together are summed up at once. Others are packed into chunks of ``most``, each chunk is summed
    up, and the summaries, numbered and in order, are the parts of the next round, until they fit. Each round's parts are written. A summary that
    makes nothing shorter is an error after ROUNDS.
    """
    now, done = kept(blocks_of(parts, key, "number", "text", head)), []
    for i in range(ROUNDS):
        size = now.groupBy("key").agg((F.sum(F.length("text") + 1) - 1).alias("size"))
        fits = kept(size.select(F.col("key").alias("of"), (F.col("size") <= limit).alias("fits")))
        judged = now.join(fits, F.col("key").eqNullSafe(F.col("of"))).drop("of")
        pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
        done.append(judged.filter("fits").groupBy("key").agg(pieces.alias("text")).select(F.col("key").alias(key), summary(F.col("text")).alias("text"), F.lit(i).cast("long").alias("rounds")))
        if not fits.filter("not fits").head(1):
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
        # Summaries only are numbered, and written: chunks are not.
        said = chunks_of(judged.filter("not fits").drop("fits"), most).select("key", "order", summary(F.col("text")).alias("text"))
        numbered = row_numbers(said, ["key"], [F.col("order")], "number")
        headed = F.concat(F.lit("## 分段 "), F.col("number").cast("string"), F.lit("\n\n"), F.col("text"))
        now = kept(blocks_of(numbered.select("key", "number", headed.alias("text")), "key", "number", "text"))
    raise ValueError(f"the summaries don't get shorter in {ROUNDS} rounds")

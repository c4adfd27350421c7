"""State that pages carry as JSON, and landed payloads of drifting shape, read as VARIANT by chains of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the pieces of a podcast may be, the present shape first; a path ends at a value, episodes at an array.
PODCAST = [("props", "pageProps", "podcast"), ("props", "podcast"), ("data",)]
EPISODES = [("episodes",), ("list",), ("transList",), ("records",)]
EPISODE = {
    "eid": ("string", [("eid",), ("id",), ("transIdStr",), ("transId",)]),
    "title": ("string", [("title",), ("name",)]),
    "description": ("string", [("description",)]),
    "duration": ("long", [("duration",)]),
    "audio_url": ("string", [("enclosure", "url"), ("audioUrl",)]),
    "image_url": ("string", [("image", "picUrl")]),
}


def field(node: str | Column, *path: str | int, kind: str = "string") -> Column:
    """A value inside a VARIANT, null where the path or the type doesn't fit."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.try_variant_get(node, F.lit("$" + steps), kind)


def first_at(node: str | Column, paths: list[tuple], kind: str = "string") -> Column:
    """The value at the first of several paths that has one; blank texts are none."""
    found = [field(node, *p, kind=kind) for p in paths]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) if kind == "string" else x for x in found])


def embedded(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tree, error) of the JSON in a page's script __NEXT_DATA__, one row a page.

    error: absent without such a script, json where it can't be parsed; tree is null then.
    """
    inside = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?s)(<script id="__NEXT_DATA__" type="application/json">)(.*?)</script>', 0)
    raw = F.regexp_replace(inside, "^<script[^>]*>|</script>$", "")
    read = pages.select(F.col(key), F.explode(F.array(F.struct((inside != "").alias("there"), F.try_parse_json(raw).alias("tree")))).alias("x"))
    return read.select(key, "x.tree", F.when(~F.col("x.there"), "absent").when(F.col("x.tree").isNull(), "json").alias("error"))


def short(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def episodes(states: DataFrame, key: str) -> DataFrame:
    """(key, pid, podcast, pos, the columns of EPISODE, error) of embedded() states: a row an episode.

    A state without a podcast, or a podcast without episodes, keeps one row with an error (podcast, episodes), as do states with one of
    their own. Texts are empty and numbers 0 where they are missing; descriptions are cut.
    """
    shows = states.withColumn("show", F.coalesce(*[field("tree", *p, kind="variant") for p in PODCAST]))
    lists = shows.select(key, "error", "show", first_at("show", EPISODES, "array<variant>").alias("items"))
    each = lists.select(key, "error", F.coalesce(first_at("show", [("pid",), ("id",)]), F.lit("")).alias("pid"), F.coalesce(first_at("show", [("title",), ("name",)]), F.lit("")).alias("podcast"), "show", F.posexplode_outer("items").alias("pos", "item"))
    empty = {"string": F.lit(""), "long": F.lit(0).cast("long")}
    values = [F.coalesce(first_at("item", paths, kind), empty[kind]).alias(name) for name, (kind, paths) in EPISODE.items()]
    error = F.coalesce("error", F.when(F.col("show").isNull(), "podcast").when(F.col("item").isNull(), "episodes"))
    out = each.select(key, "pid", "podcast", F.col("pos").cast("long").alias("pos"), *values, error.alias("error"))
    return out.withColumn("description", short(F.col("description")))


def with_details(items: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Items with their landed detail (key, payload: JSON): summary, from aiSummary or else mtSummary, and status.

    status: saved where a summary isn't blank, failed where both are or there is no detail; of several details of a key the first by text.
    """
    one = details.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.min("payload").alias("payload"))
    tree = F.try_parse_json("payload")
    joined = items.join(one.select("of", tree.alias("tree")), F.col(key) == F.col("of"), "left")
    said = first_at("tree", [("data", "aiSummary"), ("aiSummary",), ("data", "mtSummary"), ("mtSummary",)])
    return joined.select(*items.columns, said.alias("summary")).withColumn("status", F.when(F.col("summary").isNull(), "failed").otherwise("saved"))

"""Documents put together from rows of their parts: Word containers, editor blocks, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.notes import spaced_lists
from gleaner.functions.text import WHITE, blank_to_null, trimmed
from gleaner.operators.records import numbering_formats, ordinals
from gleaner.sources.readers import kept
from gleaner.sources.states import field


def normal_lines(c: Column, blank: int = 2) -> Column:
    """No white space at line ends, at most so many blank lines in a row, none at both ends."""
    clean = F.array_join(F.transform(F.split(c, "\n", -1), lambda line: F.rtrim(line, F.lit(WHITE))), "\n")
    return trimmed(F.regexp_replace(clean, r"\n{%d,}" % (blank + 2), "\n" * (blank + 1)))


def marked(text: Column, bold: Column, italic: Column, strike: Column) -> Column:
    """A run's text between the signs of its marks, strike outermost; line breaks are hard ones."""
    signs = [F.when(on, sign).otherwise("") for on, sign in ((strike, "~~"), (italic, "*"), (bold, "**"))]
    shown = F.concat(*signs, F.replace(text, F.lit("\n"), F.lit("  \n")), *signs[::-1])
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(shown)


def colored(shown: Column, color: Column) -> Column:
    """Text in a colour (six hex digits; null: none), its signs of markup escaped."""
    safe = shown
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(entity))
    return F.when(color.isNull() | (shown == ""), shown).otherwise(F.concat(F.lit('<span style="color:#'), color, F.lit('">'), safe, F.lit("</span>")))


def in_order(order: Column, text: Column) -> Column:
    """An aggregate: texts joined in the order of a struct or number; a block's or a document's texts, so bounded by the document."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), text.alias("text")))), lambda x: x["text"]), "")


def padded_tables(cells: DataFrame, keys: list[str], blank: str = " ") -> DataFrame:
    """Tables (keys, row, cell, text) as Markdown: rows padded to the longest with ``blank``, the first one is the head."""
    rows = cells.groupBy(*keys, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]).alias("cells"))
    table = rows.groupBy(*keys).agg(F.max(F.size("cells")).alias("width"), F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))

    def line(row: Column) -> Column:
        full = F.concat(F.transform(row, lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(blank))), F.array_repeat(F.lit(blank), F.col("width") - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(full, " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    body = F.transform(F.slice("rows", F.lit(2), F.size("rows")), line)
    return table.select(*keys, F.array_join(F.concat(F.array(line(F.get("rows", F.lit(0))), rule), body), "\n").alias("text"))


def word_blocks(parts: DataFrame) -> DataFrame:
    """(path, block, kind, text) of the blocks of Word containers (word_parts()): heading, item, text, empty or table.

    A paragraph's heading level and its place in a list come from its style's name where it has no list of its own; J6 gives a list's format,
    W6 its numbers, counted for each list and level of a document.
    """
    parts = parts.repartition("path")
    shown = colored(marked(F.col("text"), F.col("bold"), F.col("italic"), F.col("strike")), F.col("color"))
    of_run = lambda c: F.when(F.col("part") == "run", c)
    paragraphs = parts.filter("part in ('paragraph', 'run')").groupBy("path", "block").agg(
        *[F.max(c).alias(c) for c in ("style", "list", "level")],
        in_order(F.col("run"), of_run(F.when(F.col("direct"), shown).otherwise(""))).alias("own"), in_order(F.col("run"), of_run(F.col("text"))).alias("all"),
    )
    # What a document says of its styles and lists is small, and goes to its paragraphs as arrays: all of it stays where the document is.
    styles = parts.filter("part = 'style'").groupBy("path").agg(F.collect_list(F.struct(F.coalesce("style", F.lit("")).alias("id"), "text")).alias("styles"))
    numbers = parts.filter("part = 'number'").select(F.struct("path", F.col("list").alias("id")).alias("num_id"), F.struct("path", F.col("text").alias("id")).alias("abstract_id"))
    levels = parts.filter("part = 'level'").select(F.struct("path", F.col("list").alias("id")).alias("abstract_id"), "level", F.col("text").alias("format"), F.col("block").alias("pos"))
    formats = numbering_formats(numbers, levels).select("num_id.path", F.struct("num_id.id", "level", "format").alias("x")).groupBy("path").agg(F.collect_list("x").alias("formats"))
    named = paragraphs.join(styles, "path", "left").join(formats, "path", "left")
    of_style = F.filter("styles", lambda x: x["id"] == F.coalesce("style", F.lit("")))
    of_list = F.filter("formats", lambda x: (x["id"] == F.col("list")) & (x["level"] == F.col("level")))
    text = F.coalesce(blank_to_null(trimmed(F.col("own"))), trimmed(F.col("all")), F.lit(""))
    known = named.select("path", "block", "list", "level", text.alias("text"), F.coalesce(F.get(of_style, F.lit(0))["text"], F.lit("")).alias("name"), F.get(of_list, F.lit(0))["format"].alias("format"))
    name, low = F.col("name"), F.lower("name")
    head = F.coalesce(*[blank_to_null(F.regexp_extract(name, r"(?i)heading\s+([1-6])|标题\s*([1-6])", i)) for i in (1, 2)]).cast("int")
    by_name = F.greatest(F.coalesce(F.regexp_extract(name, r"(?i)(?:list|列表).*(\d+)$", 1).try_cast("int"), F.lit(1)) - 1, F.lit(0))
    judged = known.select(
        "path", "block", "text", "list", "format", head.alias("head"), F.when(F.col("list").isNotNull(), F.col("level")).otherwise(by_name).alias("level"),
        low.rlike("bullet|项目符号|列表").alias("bullet"), low.rlike("number|编号").alias("numbered"),
    )
    kind = F.when(F.col("text") == "", "empty").when(F.col("head").isNotNull(), "heading").when(F.col("list").isNotNull() | F.col("bullet") | F.col("numbered"), "item").otherwise("text")
    counted = ((F.col("format") != "bullet") | (F.col("format").isNull() & F.col("numbered"))) & (F.col("kind") == "item")
    items = ordinals(judged.withColumn("kind", kind), ["path", "list"], "level", "block", F.coalesce(counted, F.lit(False)))
    sign = F.coalesce(F.concat(F.col("ordinal").cast("string"), F.lit(". ")), F.lit("- "))
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("head")), F.lit(" "), F.col("text")))
    line = line.when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.col("level")), sign, F.col("text"))).otherwise(F.col("text"))
    return items.select("path", "block", "kind", line.alias("text")).unionByName(word_tables(parts))


def word_tables(parts: DataFrame) -> DataFrame:
    """Tables of Word containers; a cell that spans columns is in each of them, one merged with those above has their text."""
    cells = parts.filter("part = 'cell'").select("path", "block", "row", "cell", "span", "merged", F.replace(normal_lines(F.col("text")), F.lit("\n"), F.lit("<br>")).alias("text"))
    each = cells.withColumn("cell", F.explode(F.sequence("cell", F.col("cell") + F.col("span") - 1)))
    above = Window.partitionBy("path", "block", "cell").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = each.withColumn("text", F.coalesce(F.last(F.when(~F.col("merged"), F.col("text")), ignorenulls=True).over(above), F.lit("")))
    return padded_tables(full, ["path", "block"]).select("path", "block", F.lit("table").alias("kind"), "text")


def word_documents(parts: DataFrame) -> DataFrame:
    """(path, title, markdown, error) of Word containers (word_parts(), which is written, as each kind of part is read apart).

    A blank line follows all but items of lists; an empty paragraph ends a list. title is null where the container has none, markdown where
    nothing was found, error where all could be read.
    """
    parts = kept(parts)
    before = F.lag("kind").over(Window.partitionBy("path").orderBy("block"))
    ended = F.when(F.col("kind") == "item", "\n").when(F.col("kind") == "empty", F.when(F.col("before") == "item", "\n").otherwise("")).otherwise("\n\n")
    pieces = word_blocks(parts).withColumn("before", before).select("path", "block", F.concat("text", ended).alias("text"))
    bodies = pieces.groupBy("path").agg(blank_to_null(normal_lines(in_order(F.col("block"), F.col("text")))).alias("markdown"))
    about = parts.groupBy("path").agg(*[F.min(F.when(F.col("part") == p, blank_to_null(F.col("text")))).alias(p) for p in ("title", "error")])
    return about.join(bodies, "path", "left").select("path", "title", "markdown", "error")


#: So many levels of a tree one pass descends, as arrays of a row.
LEVELS = 8


def tree_nodes(trees: DataFrame, key: str, root: Column, children: str, fields: str, columns: list[Column], about: list[str]) -> DataFrame:
    """(key, about, place, columns) of all nodes of VARIANT trees: place is the numbers of the node's ancestors and itself among their siblings.

    root: an array of VARIANT; children: the field of a node's children, and fields the others with their types, which are read at once; columns:
    what is wanted of a node, from column ``node``, a struct of these; about: columns of the trees. A tree without nodes has one row, its place
    null. What is below a node at the top is descended in arrays, LEVELS levels a pass; what is wanted of nodes is written, subtrees only where
    a tree goes on below a pass.
    """
    kind = f"struct<`{children}`: array<variant>, {fields}>"
    at = lambda place, node: F.struct(place.alias("place"), F.try_variant_get(node, F.lit("$"), kind).alias("node"))

    def below(nodes: Column) -> Column:
        inside = lambda x: F.transform(x["node"][children], lambda node, i: at(F.concat(x["place"], F.array(i)), node))
        return F.flatten(F.transform(F.filter(nodes, lambda x: x["node"][children].isNotNull()), inside))

    tops = trees.select(key, *about, F.posexplode_outer(root).alias("pos", "node"))
    level = tops.select(key, *about, F.array(at(F.when(F.col("pos").isNotNull(), F.array("pos")), F.col("node"))).alias("level"))
    out, deepest = None, 0
    while True:
        deepest += LEVELS
        names = ["level", *(f"level{n}" for n in range(1, LEVELS))]
        for above, name in zip(names, names[1:]):
            level = level.withColumn(name, below(F.col(above)))
        nodes = level.select(key, *about, F.explode(F.concat(*names)).alias("x")).select(key, *about, "x.place", "x.node")
        rest = F.when(F.size("place") == deepest, F.col("node")[children])
        found = kept(nodes.select(key, *about, "place", *columns, rest.alias("rest")))
        out = found.drop("rest") if out is None else out.unionByName(found.drop("rest"))
        deeper = found.filter("rest is not null")
        if not deeper.head(1):
            return out
        level = deeper.select(key, *about, F.transform("rest", lambda node, i: at(F.concat("place", F.array(i)), node)).alias("level"))


#: What an editor's block has: attributes, type and runs, each of these with its text and marks.
BLOCK = "`4`: struct<l: string, lt: string, ll: string, li: string, u: string, url: string>, `6`: string, `7`: array<struct<`8`: string, `9`: array<struct<`2`: string>>>>"


def own_text(runs: Column) -> Column:
    """The text of a block's own runs, between their marks."""

    def run(x: Column) -> Column:
        has = lambda name: F.coalesce(F.exists(x["9"], lambda m: m["2"] == name), F.lit(False))
        return marked(x["8"], has("b"), has("i"), has("s"))

    return F.coalesce(F.array_join(F.transform(runs, run), ""), F.lit(""))


def editor_documents(notes: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, markdown, error) of notes in the JSON of a block editor, one row a key; nulls are errors.

    A block is an image (6: im), a heading (h with its level in l, or h1 to h6), an item of a list (l, or lt: ordered, unordered; level ll,
    list li), a rule (hr), or a text: that of its own runs (7) and of all blocks inside (5), of any depth and type. A block without text gives
    what the blocks inside give. error: json where the content isn't JSON, blocks where it has no list of blocks; markdown is null then, and
    where nothing was found.
    """
    parsed = notes.select(F.col(key).alias("key"), F.try_parse_json(content).alias("tree")).withColumn("blocks", field("tree", "5", kind="array<variant>"))
    parsed = parsed.withColumn("error", F.when(F.col("tree").isNull(), "json").when(F.col("blocks").isNull(), "blocks"))
    about = lambda name: F.col("node")["4"][name]
    columns = [
        F.coalesce(F.col("node")["6"], F.lit("")).alias("type"), blank_to_null(about("l")).alias("l"), about("lt").alias("lt"), F.coalesce(F.nullif(about("ll").try_cast("int"), F.lit(0)), F.lit(1)).alias("level"),
        blank_to_null(about("li")).alias("li"), F.coalesce(blank_to_null(about("u")), blank_to_null(about("url")), F.lit("")).alias("url"), own_text(F.col("node")["7"]).alias("own"),
    ]
    nodes = tree_nodes(parsed, "key", F.col("blocks"), "5", BLOCK, columns, ["error"])
    listed = (F.col("type") == "l") | F.coalesce(F.col("lt").isin("ordered", "unordered"), F.lit(False))
    # Places sort as a document is read, and what is inside a block comes up to its end. From here on a document stays together.
    end = F.concat("place", F.array(F.lit(2**31 - 1)))
    ordered = Window.partitionBy("key").orderBy("place")
    upto, before = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A block is closed if it shows itself or has a text inside; the outermost closed block around a node is the one that it belongs to.
    text_at = F.last(F.when(F.col("own").rlike(r"(?U)\S"), F.col("place")), ignorenulls=True).over(after)
    known = nodes.filter("key is not null and place is not null").drop("error").withColumn("text_at", text_at)
    closed = F.coalesce(F.col("text_at") <= end, F.lit(False)) | F.col("type").isin("im", "hr") | listed
    judged = known.withColumn("closed", closed).withColumn("around", F.max(F.when(F.col("closed"), end)).over(before)).withColumn("pos", F.row_number().over(ordered))
    outer = F.col("closed") & F.coalesce(F.col("place") > F.col("around"), F.lit(True))
    mine = F.last(F.when(outer, F.struct("pos", end.alias("end"))), ignorenulls=True).over(upto)
    units = judged.withColumn("mine", mine).filter(F.col("place") <= F.col("mine.end")).withColumn("block", F.col("mine.pos"))
    about_block = F.max(F.when(F.col("pos") == F.col("block"), F.struct("type", "l", "lt", "level", "li", "url"))).alias("x")
    shown = units.groupBy("key", "block").agg(trimmed(in_order(F.col("pos"), F.col("own"))).alias("text"), about_block).select("key", F.col("block").alias("pos"), "text", "x.*")
    counted = listed & (F.col("type") != "im") & (F.col("lt") == "ordered") & ~((F.col("type") == "h") & (F.col("text") != ""))
    marks = shown.withColumn("list", F.coalesce("li", F.concat(F.lit("default-"), F.col("level").cast("string"))))
    numbered = ordinals(marks, ["key", "list"], "level", "pos", F.coalesce(counted, F.lit(False)))
    head = F.when(F.col("type") == "h", F.coalesce(blank_to_null(F.regexp_extract(F.coalesce("l", F.lit("")), "^h([1-6])$", 1)).cast("int"), F.lit(2)))
    title = F.concat(F.repeat(F.lit("#"), head), F.lit(" "), F.col("text"), F.lit("\n\n"))
    sign = F.coalesce(F.concat(F.col("ordinal").cast("string"), F.lit(". ")), F.lit("- "))
    item = F.when(F.col("text") == "", "\n").otherwise(F.concat(F.repeat(F.lit("\t"), F.greatest(F.col("level") - 1, F.lit(0))), sign, F.col("text"), F.lit("\n")))
    other = F.concat(F.repeat(F.lit("#"), F.regexp_extract("type", "^h([1-6])$", 1).try_cast("int")), F.lit(" "), F.col("text"), F.lit("\n\n"))
    image = F.when(F.col("url") != "", F.concat(F.lit("![]("), F.col("url"), F.lit(")\n\n"))).otherwise("")
    has = F.col("text") != ""
    block = F.when(F.col("type") == "im", image).when(has & (F.col("type") == "h"), title).when(listed, item).when(has & F.col("type").rlike("^h[1-6]$"), other)
    block = block.when(F.col("type") == "hr", "---\n\n").otherwise(F.concat("text", F.lit("\n\n")))
    bodies = numbered.select("key", "pos", block.alias("text")).groupBy("key").agg(in_order(F.col("pos"), F.col("text")).alias("text"))
    markdown = blank_to_null(normal_lines(spaced_lists(F.col("text"))))
    every = nodes.filter("place is null or place = array(0)").select("key", "error")
    return every.join(bodies.select("key", markdown.alias("markdown")), "key", "left").select(F.col("key").alias(key), "markdown", "error")

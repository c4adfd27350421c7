"""Articles of web pages, from their nodes: fields by selectors, the richest subtree, and Markdown with inherited styles.

All of it is joins and aggregates of the table of nodes (sources/markup.py): what is inside an element is what has the element in its path, and
what a text inherits is what the elements in its path say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.notes import at_once, color_of, hex_color, note_width, shown_color, shown_ground, shown_width, style_colors
from gleaner.functions.text import blank_to_null, contrast, luminance, squeezed, trimmed
from gleaner.operators.documents import in_order, padded_tables
from gleaner.sources.markup import has_class, with_text
from gleaner.sources.readers import kept


def attribute(name: str) -> Column:
    return F.coalesce(F.col("attributes")[name], F.lit(""))


Selector = tuple[str, dict[str, str]]


def element(tag: str, **attributes: str) -> Selector:
    """A selector: a tag with attributes; class_ is one of the classes."""
    return tag, attributes


def matches(selector: Selector) -> Column:
    tag, attributes = selector
    tests = [has_class(v) if k == "class_" else attribute(k) == v for k, v in attributes.items()]
    return reduce(lambda a, b: a & b, tests, F.col("tag") == tag)


def texts_inside(nodes: DataFrame, chosen: DataFrame, between: str = "") -> DataFrame:
    """(page, node, text) of the chosen elements (page, node): the texts inside, each stripped, joined; elements without text are left out."""
    leaves = nodes.filter(with_text()).select("page", F.col("node").alias("leaf"), trimmed(F.col("text")).alias("piece"), F.explode("path.node").alias("node"))
    inside = leaves.filter("piece <> ''").join(chosen.select("page", "node").distinct(), ["page", "node"])
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("leaf", "piece"))), lambda x: x["piece"])
    return inside.groupBy("page", "node").agg(F.array_join(pieces, between).alias("text"))


def first_of(nodes: DataFrame, rules: list[tuple[str, Selector, str]]) -> DataFrame:
    """(page, field, turn, node, content) of the first element in the order of the page that each rule (field, selector, source) finds.

    content is an attribute's value where the rule's source names one, else null: the element's text is meant.
    """
    found = F.array(*[F.when(matches(test), F.struct(F.lit(name).alias("field"), F.lit(i).alias("turn"), (attribute(source) if source else F.lit(None)).cast("string").alias("content"))) for i, (name, test, source) in enumerate(rules)])
    hits = nodes.select("page", "node", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("page", "node", "x.*")
    return hits.groupBy("page", "field", "turn").agg(F.min("node").alias("node"), F.min_by("content", "node").alias("content"))


#: Selectors of an article's fields, in the order in which they are tried.
FIELDS = [
    ("title", element("meta", property="og:title"), "content"),
    ("title", element("h1", class_="rich_media_title"), ""),
    ("title", element("h1"), ""),
    ("author", element("a", id="js_name"), ""),
    ("author", element("span", class_="rich_media_meta_nickname"), ""),
    ("account_name", element("strong", class_="profile_nickname"), ""),
    ("publish_time", element("em", id="publish_time"), ""),
    ("publish_time", element("span", class_="rich_media_meta_date"), ""),
]
CONTENT = [element("div", id="js_content"), element("div", class_="rich_media_content"), element("div", class_="article-content")]
#: Where a page's title may be; of the title element only a text without further elements counts.
TITLES = [
    ("title", element("meta", property="og:title"), "content"),
    ("title", element("meta", name="twitter:title"), "content"),
    ("title", element("meta", name="title"), "content"),
    ("title", element("title"), ""),
    ("title", element("h1"), ""),
]
#: Elements that may hold a page's content.
CANDIDATES = [
    element("article"),
    element("main"),
    element("body"),
]


def fields_of(nodes: DataFrame, rules: list[tuple[str, Selector, str]] = FIELDS, between: str = "") -> DataFrame:
    """(page, field, value): of each field's rules the first whose element has a value that isn't blank."""
    found = first_of(nodes, rules)
    texts = texts_inside(nodes, found.filter("content is null"), between)
    valued = found.join(texts, ["page", "node"], "left").select("page", "field", "turn", blank_to_null(trimmed(F.coalesce("content", "text"))).alias("value"))
    return valued.filter("value is not null").groupBy("page", "field").agg(F.min_by("value", "turn").alias("value"))


def titles_of(nodes: DataFrame) -> DataFrame:
    """(page, title) by TITLES, white space collapsed, cut to 200 characters; pages without any are left out."""
    return fields_of(nodes, TITLES, " ").select("page", squeezed(F.col("value")).alias("title"))


def content_of(nodes: DataFrame, rules: list[Selector] = CONTENT) -> DataFrame:
    """(page, root, last): each page's first element by the first selector that finds one."""
    found = first_of(nodes, [("content", test, "") for test in rules])
    best = found.groupBy("page").agg(F.min_by("node", "turn").alias("root"))
    return best.join(nodes.select("page", F.col("node").alias("root"), "last"), ["page", "root"])


def richest_of(nodes: DataFrame, rules: list[Selector] = CANDIDATES, least: int = 20) -> DataFrame:
    """(page, root, last, length): the element with most visible text, among all that the selectors find, of at least so many characters.

    Of equally long ones the first selector's, then the first on the page.
    """
    turns = F.array_compact(F.array(*[F.when(matches(test), F.lit(i)) for i, test in enumerate(rules)]))
    found = nodes.withColumn("turn", F.array_min(turns)).filter("turn is not null").select("page", F.col("node").alias("root"), "last", "turn")
    texts = texts_inside(nodes, found.select("page", F.col("root").alias("node"))).select("page", F.col("node").alias("root"), F.length("text").cast("long").alias("length"))
    sized = found.join(texts, ["page", "root"]).filter(F.col("length") >= least)
    best = sized.groupBy("page").agg(F.max_by(F.struct("root", "last", "length"), F.struct("length", -F.col("turn"), -F.col("root"))).alias("best"))
    return best.select("page", "best.*")


VIDEOS = ("mpvideo", "video", "iframe")
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A state: what an element's content becomes (kind), the element it becomes one with (unit), and a depth or number.
STATE = "struct<kind: string, unit: int, nth: int>"


def entered(state: Column, e: Column) -> Column:
    """The state of what is inside element e, from that of e's place; what has been taken as one unit stays so."""
    tag = e["tag"]

    def to(kind: str | Column, unit: Column = F.lit(None), nth: Column = F.lit(0)) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), unit.cast("int").alias("unit"), nth.cast("int").alias("nth"))

    whole = tag.isin("table", "pre", "code", *HEADS) | ((tag == "a") & e["link"])
    flow = (
        F.when(tag.isin("script", "style", "noscript") | tag.isin(*VIDEOS[:2]) | ((tag == "iframe") & e["link"]), to("drop"))
        .when(whole, to(tag, e["node"])).when(tag.isin("ul", "ol"), to(tag)).when(tag == "blockquote", to("quote")).otherwise(to("flow"))
    )
    item, kind = tag == "li", state["kind"]
    return (
        F.when(kind == "flow", flow)
        .when(kind == "quote", F.when(tag == "p", to("quoted", e["node"])).otherwise(flow))
        .when(kind == "ol", F.when(item, to("number", e["node"], e["nth"])).otherwise(to("drop")))
        .when(kind == "ul", F.when(item, to("item", nth=state["nth"])).otherwise(to("drop")))
        .when(kind == "item", F.when(tag.isin("ul", "ol"), to("ul", nth=state["nth"] + 1)).otherwise(to("bullet", e["node"], state["nth"])))
        .otherwise(state)
    )


#: Elements that end the state flow; most nodes have none around them, so no fold goes over their paths.
TURNS = ("script", "style", "noscript", *VIDEOS, "table", "pre", "code", *HEADS, "a", "ul", "ol", "blockquote")


def state_of(path: Column) -> Column:
    begin = F.struct(F.lit("flow").alias("kind"), F.lit(None).cast("int").alias("unit"), F.lit(0).alias("nth"))
    return F.when(F.exists(path, lambda x: x["tag"].isin(*TURNS)), F.aggregate(path, begin, entered)).otherwise(begin)


def linked(c: Column) -> Column:
    """Each URL of a text as a link, but where it is one already."""
    urls = F.regexp_extract_all(c, F.lit(r'(https?://[^\s<>"{}|\\^`\[\]]+)'), F.lit(1))

    def link(out: Column, url: Column) -> Column:
        named = F.concat(F.lit("["), url, F.lit("]"))
        return F.when(F.contains(out, named), out).otherwise(F.replace(out, url, F.concat(named, F.lit("("), url, F.lit(")"))))

    return F.aggregate(urls, c, link)


def parsed(styles: DataFrame) -> DataFrame:
    """Style with color (text, light: its luminance) and ground (hex, light, bright), each parsed once; null where it says nothing."""
    out = style_colors(styles, "style")
    color, ground = color_of("color"), color_of("ground")
    light = lambda c: luminance(c["r"], c["g"], c["b"])
    out = at_once(at_once(out, "text", shown_color(color)), "fill", shown_ground(ground))
    bright = (ground["r"] * 299 + ground["g"] * 587 + ground["b"] * 114) / 1000 > 128
    said = F.when(F.col("text") != "", F.struct("text", light(color).alias("light")))
    filled = F.when(F.col("fill") != "", F.struct(hex_color(ground).alias("hex"), light(ground).alias("light"), bright.alias("bright")))
    return out.select("style", said.alias("color"), filled.alias("ground"))


def styled(text: Column, bold: Column, italic: Column, underline: Column, color: Column, ground: Column) -> Column:
    """A text between the tags of what it inherits (parsed()); a colour too close to its ground goes, on a dark one it becomes white."""
    close = color["light"].isNotNull() & ground["light"].isNotNull() & (contrast(color["light"], ground["light"]) < 4.5)
    seen = F.when(close, F.when(ground["bright"], "").otherwise("rgb(255, 255, 255)")).otherwise(F.coalesce(color["text"], F.lit("")))
    tags = [(ground.isNotNull(), F.concat(F.lit('<mark style="background: '), ground["hex"], F.lit(';">')), "mark")]
    tags += [((seen != "") & ~seen.contains("transparent"), F.concat(F.lit('<span style="color:'), seen, F.lit('">')), "span")]
    tags += [(on, F.lit(f"<{tag}>"), tag) for on, tag in ((underline, "u"), (bold, "b"), (italic, "i"))]
    around = lambda on, x: F.when(on, x).otherwise("")
    return F.concat(*[around(on, x) for on, x, _ in tags], text, *[around(on, F.lit(f"</{tag}>")) for on, _, tag in tags[::-1]])


def leaves_of(nodes: DataFrame, images: DataFrame | None) -> DataFrame:
    """Nodes with what they show: texts, videos as numbered notes (mpvideo before video before iframe), images by the landed ones (src, name,
    width) or a note that one is missing. Adds ``shown`` (text that takes part as such) and ``image``."""
    src = F.coalesce(*[blank_to_null(attribute(a)) for a in ("src", "data-src", "data-original")])
    is_video = F.col("tag").isin(*VIDEOS[:2]) | ((F.col("tag") == "iframe") & F.lower(attribute("src")).rlike("video|player"))
    rank = F.when(is_video, F.array_position(F.array(*map(F.lit, VIDEOS)), F.col("tag")))
    videos = nodes.filter(is_video).select("page", F.struct(rank.alias("rank"), "node").alias("v")).groupBy("page").agg(F.sort_array(F.collect_list("v")).alias("v"))
    # The videos of a page go to its nodes as an array, so that nodes are not moved for them.
    place = F.array_position(F.transform("v", lambda x: x["node"]), F.col("node"))
    out = nodes.join(videos, "page", "left").withColumn("video", F.when(is_video, F.nullif(place, F.lit(0).cast("long")))).withColumn("src", F.when(F.col("tag") == "img", src)).drop("v")
    landed = images if images is not None else nodes.sparkSession.createDataFrame([], "src string, name string, width long")
    out = out.join(landed.select(F.col("src").alias("of"), "name", "width"), F.col("src") == F.col("of"), "left").drop("of")
    remote = F.col("src").startswith("http")
    size = note_width(F.col("width"), shown_width(attribute("style"), attribute("width"), attribute("data-w"), attribute("data-width")))
    file = F.when(remote, F.col("name")).otherwise(F.when(~attribute("src").startswith("http"), blank_to_null(attribute("src"))))
    sized = F.when(remote & (size > 0), F.concat(F.lit("|"), size.cast("string"))).otherwise("")
    image = F.when((F.col("tag") == "img") & file.isNotNull(), F.concat(F.lit("![["), file, sized, F.lit("]]\n")))
    lost = F.when((F.col("tag") == "img") & remote & F.col("name").isNull(), F.concat(F.lit("\n> ⚠️ **图片下载失败**: [查看原图]("), F.col("src"), F.lit(")\n")))
    note = F.concat(F.lit("\n\n> 🎥 **视频位置 "), F.col("video").cast("string"), F.lit("** - 请在原文中观看\n\n"))
    return out.select("page", "node", "last", "tag", "attributes", "nth", "path", F.coalesce(F.when(F.col("tag") == "", F.col("text")), note, lost).alias("shown"), image.alias("image"))


def article_markdown(nodes: DataFrame, roots: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(page, markdown, images, videos) of the elements ``roots`` (page, root, last), one a page.

    images (src, name, width): what has been fetched. Texts inherit bold, italics, underline, colour and ground from all elements between
    them and the root; headings, lists, quotes, tables, code and links are taken as one with the text inside. A table inside a table is also
    rows of the outer one. markdown is null where nothing is shown.
    """
    inner = F.filter("path", lambda x: x["node"] > F.col("root"))
    joined = nodes.join(roots.withColumnRenamed("last", "end"), "page").filter((F.col("node") > F.col("root")) & (F.col("node") <= F.col("end")))
    inside = joined.filter(~F.exists("path", lambda x: x["tag"].isin("script", "style", "template"))).withColumn("path", inner).drop("root", "end")
    has_text = F.coalesce(F.col("shown").rlike(r"(?U)\S"), F.lit(False))
    rows = kept(leaves_of(inside, images).withColumn("state", state_of(F.col("path"))).withColumn("has_text", has_text))
    kind, unit, nth, has_text = F.col("state.kind"), F.col("state.unit"), F.col("state.nth"), F.col("has_text")
    # Texts on their own, with what they inherit.
    flow = rows.filter((kind == "flow") & has_text)
    styles = kept(parsed(rows.select(attribute("style").alias("style")).filter("style <> ''").distinct()))
    said = rows.select("page", "node", attribute("style").alias("style")).filter("style <> ''").join(styles.filter("color is not null or ground is not null"), "style")
    pairs = flow.select("page", F.col("node").alias("leaf"), F.explode("path.node").alias("node")).join(said, ["page", "node"])
    nearest = pairs.groupBy("page", F.col("leaf").alias("node")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("node"))).alias(c) for c in ("color", "ground")])
    on = lambda *tags: F.exists("path", lambda x: x["tag"].isin(*tags))
    texts = flow.join(nearest, ["page", "node"], "left").select("page", F.col("node").alias("pos"), F.lit(0).alias("end"), linked(styled(F.col("shown"), on("strong", "b"), on("em", "i"), on("u"), F.col("color"), F.col("ground"))).alias("text"))
    # Texts that are one with an element, or with their place in a list or quote.
    own = F.when(kind.isin("quote", "item"), F.col("node")).otherwise(unit)
    units = rows.filter(has_text & ~kind.isin("flow", "drop", "ul", "ol", "table")).select(
        "page", own.alias("pos"), F.when(kind == "item", "bullet").when(kind == "quote", "quoted").otherwise(kind).alias("kind"), nth.alias("nth"), F.col("node").alias("leaf"), "shown",
        F.array_min(F.transform(F.filter("path", lambda x: (x["tag"] == "code") & (x["node"] > unit)), lambda x: x["node"])).alias("code"),
    )
    whole = units.groupBy("page", "pos", "kind", "nth").agg(in_order(F.col("leaf"), trimmed(F.col("shown"))).alias("text"), F.min("code").alias("code"), in_order(F.col("leaf"), F.col("shown")).alias("raw"), F.array_sort(F.collect_list(F.struct("leaf", "code", "shown"))).alias("all"))
    of_code = F.array_join(F.transform(F.filter("all", lambda x: x["code"] == F.col("code")), lambda x: x["shown"]), "")
    code = trimmed(F.when(F.col("code").isNotNull(), of_code).otherwise(F.col("raw")))
    about = rows.select("page", F.col("node").alias("pos"), "attributes")
    codes = rows.filter("tag = 'code'").select("page", F.col("node").alias("code"), attribute("class").alias("code_class"))
    full = whole.join(about, ["page", "pos"], "left").join(codes, ["page", "code"], "left")
    text = F.col("text")
    shown = F.when(F.col("kind") == "quoted", F.concat(F.lit("> "), text, F.lit("\n"))).when(F.col("kind") == "bullet", F.concat(F.repeat(F.lit("\t"), F.col("nth")), F.lit("- "), text, F.lit("\n")))
    shown = shown.when(F.col("kind") == "number", F.concat(F.col("nth").cast("string"), F.lit(". "), text, F.lit("\n"))).when(F.col("kind") == "code", F.concat(F.lit("`"), text, F.lit("`")))
    shown = shown.when(F.col("kind") == "a", F.concat(F.lit("["), text, F.lit("]("), attribute("href"), F.lit(")")))
    shown = shown.when(F.col("kind") == "pre", F.concat(F.lit("\n```"), code_language(attribute("class"), F.col("code_class")), F.lit("\n"), code, F.lit("\n```\n")))
    shown = shown.otherwise(F.concat(F.repeat(F.lit("#"), F.substring("kind", 2, 1).try_cast("int")), F.lit(" "), text, F.lit("\n")))
    blocks = full.select("page", "pos", F.lit(0).alias("end"), shown.alias("text"))
    # Images and breaks between texts, and the ends of paragraphs.
    signs = rows.filter(kind.isin("flow", "quote") & (F.col("image").isNotNull() | (F.col("tag") == "br"))).select("page", F.col("node").alias("pos"), F.lit(0).alias("end"), F.coalesce("image", F.lit("\n")).alias("text"))
    is_end = F.col("tag").isin("p", "section") & (entered(F.col("state"), F.struct("node", "tag", "nth", F.lit(False).alias("link")))["kind"] == "flow")
    ends = rows.filter(is_end).select("page", F.col("last").alias("pos"), F.lit(1).alias("end"), F.lit("\n").alias("text"))
    pieces = texts.unionByName(blocks).unionByName(signs).unionByName(ends).unionByName(article_tables(rows))
    joined = pieces.groupBy("page").agg(in_order(F.struct("pos", "end"), F.col("text")).alias("text"))
    clean = trimmed(F.regexp_replace(F.regexp_replace("text", r"\n[ \t]+\n", "\n\n"), r"\n{3,}", "\n\n"))
    counts = rows.groupBy("page").agg(F.count("image").alias("images"), F.count_if(F.col("shown").startswith("\n\n> 🎥 ")).alias("videos"))
    return roots.select("page").join(joined.select("page", blank_to_null(clean).alias("markdown")), "page", "left").join(counts, "page", "left").select("page", "markdown", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("images", "videos")])


def article_tables(rows: DataFrame) -> DataFrame:
    """Tables as pieces (page, pos, end, text); a cell belongs to every row around it."""
    cells = rows.filter(F.col("tag").isin("td", "th") & (F.col("state.kind") == "table"))
    of = F.filter("path", lambda x: (x["tag"] == "tr") & (x["node"] > F.col("state.unit")))
    placed = cells.select("page", F.col("state.unit").alias("pos"), F.explode(F.transform(of, lambda x: x["node"])).alias("row"), F.col("node").alias("cell"))
    held = rows.filter((F.col("state.kind") == "table") & F.col("has_text")).select("page", F.col("node").alias("leaf"), trimmed(F.col("shown")).alias("piece"), F.explode("path.node").alias("cell"))
    texts = held.join(cells.select("page", F.col("node").alias("cell")), ["page", "cell"]).groupBy("page", "cell").agg(in_order(F.col("leaf"), F.col("piece")).alias("text"))
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    full = placed.join(texts, ["page", "cell"], "left").withColumn("text", safe)
    return padded_tables(full, ["page", "pos"], "").select("page", "pos", F.lit(0).alias("end"), F.concat(F.lit("\n"), "text", F.lit("\n")).alias("text"))


#: The languages that a class alone names, and those that have another name in notes.
LANGUAGES = (
    "python javascript js typescript ts java c cpp c++ csharp c# go golang rust ruby php swift kotlin scala r sql html css shell bash sh powershell json xml yaml yml markdown md"
).split()
RENAMED = {"js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp", "golang": "go", "sh": "bash", "yml": "yaml", "md": "markdown"}


def code_language(block: Column, inside: Column) -> Column:
    """The language by the first class of a block of the form language-x or lang-x, or that is one of LANGUAGES; else by a class of such
    a form of the code inside; else ''."""
    prefixed = r"^lang(?:uage)?-"
    classes = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")
    own = F.filter(classes(block), lambda x: F.regexp_like(x, F.lit(prefixed)) | x.isin(*LANGUAGES))
    within = F.filter(classes(inside), lambda x: F.regexp_like(x, F.lit(prefixed)))
    name = F.regexp_replace(F.coalesce(F.get(own, F.lit(0)), F.get(within, F.lit(0)), F.lit("")), prefixed, "")
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])[name], name)

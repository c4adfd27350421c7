"""Documents converted from containers, editor blocks and pages that the tests make."""

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import trimmed
from gleaner.operators import documents
from gleaner.operators.documents import editor_documents, normal_lines, word_blocks, word_documents
from gleaner.operators.pages import article_markdown, content_of, element, fields_of, richest_of, titles_of
from gleaner.sources.containers import word_parts
from gleaner.sources.markup import page_nodes
from gleaner.sources.readers import kept

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="n"><w:name w:val="Normal"/></w:style>
<w:style w:styleId="h"><w:name w:val="heading 1"/></w:style><w:style w:styleId="z"><w:name w:val="标题 3"/></w:style>
<w:style w:styleId="lb"><w:name w:val="List Bullet"/></w:style><w:style w:styleId="lb2"><w:name w:val="List Bullet 2"/></w:style><w:style w:styleId="ln"><w:name w:val="List Number"/></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"/></w:abstractNum>
<w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""


def paragraph(runs, style=None, num=None):
    about = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{about}</w:pPr>{runs}</w:p>"


def run(text, marks=""):
    return f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def container(body, title=None, styles=STYLES, numbering=NUMBERING):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        if title:
            z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
        if styles:
            z.writestr("word/styles.xml", styles)
        if numbering:
            z.writestr("word/numbering.xml", numbering)
        if body is not None:
            z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>")
    return held.getvalue()


@pytest.fixture(scope="module")
def words(spark):
    red = '<w:color w:val="FF0000"/>'
    memo = [
        paragraph(run("一级标题"), "h"), paragraph(run("三级"), "z"), paragraph(run("第一条"), "lb"), paragraph(run("第二层"), "lb2"),
        paragraph(run("重点", "<w:b/>") + run(" 和 ") + run("红色 &lt;", red)),
        paragraph(run("one"), num=(5, 0)), paragraph(run("deep"), num=(5, 1)), paragraph(run("two"), num=(5, 0)), paragraph(run(" "), num=(5, 0)), paragraph(run("three"), num=(5, 0)),
        paragraph(run("own"), "ln"), paragraph(run("")), paragraph(run("")), paragraph("<w:hyperlink>" + run("only a link") + "</w:hyperlink>"),
        paragraph(run("a") + "<w:hyperlink>" + run("lost") + "</w:hyperlink><w:r><w:tab/><w:br/><w:br w:type='page'/><w:noBreakHyphen/></w:r>" + run("not bold", '<w:b w:val="false"/>')),
        "<w:tbl><w:tr><w:tc><w:p>" + run("h1") + "</w:p><w:p>" + run("more") + "</w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p>" + run("wide") + "</w:p></w:tc></w:tr></w:tbl>",
    ]
    good = container("".join(memo), "测试会议")
    rows = [("memo", good), ("cut", good[: len(good) // 2]), ("text", b"no container"), ("bare", container(paragraph(run("plain")), styles=None, numbering=None)), ("none", container(None)), ("empty", container("")), ("null", None)]
    rows += [("bad", container(paragraph(run("kept")) + "<w:p><broken")), ("long", container("".join(paragraph(run(f"p{i}")) for i in range(9000)) + paragraph(run("y" * 1_000_000))))]
    return spark.createDataFrame(rows, "path string, content binary").selectExpr("path", "content", "1 AS block", "2 AS text", "3 AS part")


def test_word_documents(words):
    got = {r.path: r for r in word_documents(word_parts(words)).collect()}
    want = [
        "# 一级标题", "", "### 三级", "", "- 第一条", "  - 第二层", '**重点** 和 <span style="color:#FF0000">红色 &lt;</span>', "",
        "1. one", "  - deep", "2. two", "", "3. three", "1. own", "", "only a link", "", "a\t", "-not bold", "", "| h1<br>more |   |", "| --- | --- |", "| wide | wide |",
    ]
    assert got["memo"].title == "测试会议" and got["memo"].error is None
    assert got["memo"].markdown.split("\n") == [x.rstrip() if x == "a\t" else x for x in want]
    assert (got["bare"].title, got["bare"].markdown) == (None, "plain")
    assert got["cut"].error and got["text"].error == "BadZipFile" and got["none"].error and got["none"].markdown is None
    assert got["empty"].markdown is None and got["empty"].error is None and "null" not in got
    assert got["bad"].markdown == "kept" and got["bad"].error == "ParseError"
    assert got["long"].markdown.count("\n\n") == 9000 and len(got["long"].markdown) > 1_000_000
    assert word_documents(word_parts(words.limit(0))).count() == 0
    assert {r.kind for r in word_blocks(word_parts(words)).filter("path = 'memo'").collect()} == {"heading", "item", "text", "empty", "table"}


def note(*blocks):
    return json.dumps({"5": list(blocks)})


def test_editor_documents(spark):
    text = lambda x, **marks: {"6": "p", "7": [{"8": x, **marks}]}
    deep = {"6": "x"}
    inner = deep
    for _ in range(30):
        inner["5"] = [{"6": "y"}]
        inner = inner["5"][0]
    inner["5"] = [{"6": "im", "4": {"u": "http://i"}}]
    first = note(
        {"6": "h", "4": {"l": "h2"}, "7": [{"8": "标题"}]}, {"6": "l", "4": {"lt": "ordered", "ll": 1, "li": "a"}, "7": [{"8": "第一条"}]}, {"6": "l", "4": {"lt": "ordered", "ll": 1, "li": "a"}, "7": [{"8": "第二条"}]},
        text("重点", **{"9": [{"2": "b"}]}), {"6": "l", "7": []}, {"6": "l", "4": {"lt": "ordered", "ll": 1}, "7": [{"8": "other"}]}, {"6": "l", "4": {"lt": "unordered", "ll": 2}, "7": [{"8": "bullet"}]}, 7, "x", deep,
        {"6": "unknown", "5": [text("in"), {"6": "h1", "5": [text("side")]}]}, {"6": "hr"}, {"6": "im"}, {"6": "h9", "7": [{"8": "a\nb"}]}, {"6": "h", "4": {"l": "h8"}, "7": [{"8": 12}]}, {"6": "h"},
    )
    rows = [("a", first), ("b", "<p>html</p>"), ("c", '{"5": 3}'), ("d", None), ("e", '{"5": []}'), ("f", note(text("x" * 1_000_000)))]
    table = spark.createDataFrame(rows, "path string, content string").selectExpr("*", "1 AS key", "2 AS place", "3 AS node", "4 AS own")
    got = {r.path: (r.markdown, r.error) for r in editor_documents(table).collect()}
    want = ["## 标题", "", "1. 第一条", "2. 第二条", "", "**重点**", "", "", "1. other", "\t- bullet", "", "![](http://i)", "", "inside", "", "---", "", "a  ", "b", "", "## 12"]
    assert got["a"][0].split("\n") == [x.rstrip() for x in want] and got["a"][1] is None
    assert got["b"] == (None, "json") and got["c"] == (None, "blocks") and got["d"] == (None, "json") and got["e"] == (None, None)
    assert len(got["f"][0]) == 1_000_000
    assert editor_documents(table.limit(0)).count() == 0


def test_editor_documents_write_blocks_once(spark, monkeypatch):
    """levels are descended in a pass and texts moved by document only; each level was written twice, and texts were shuffled three times."""
    written = []
    monkeypatch.setattr(documents, "kept", lambda df: written.append(df) or kept(df))
    six = {"6": "p", "7": [{"8": "text"}]}
    for _ in range(5):
        six = {"6": "x", "5": [six]}
    found = editor_documents(spark.createDataFrame([("a", note(six, six)), ("b", "{")], "path string, content string"))
    assert {r.path: (r.markdown, r.error) for r in found.collect()} == {"a": ("text\n\ntext", None), "b": (None, "json")}
    assert len(written) == 1
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sum("Exchange" in x and "own" in x for x in plan.split("\n")) <= 1


def plain_text(node):
    """What a block says, by a plain loop; marks aside."""
    if not isinstance(node, dict):
        return ""
    return "".join([str(r["8"]) for r in node.get("7", [])] + [plain_text(x) for x in node.get("5", [])])


def plain_blocks(node, counts):
    kind, about = node.get("6"), node.get("4", {})
    if kind == "im":
        return [f"![]({about['u']})", ""] if about.get("u") else []
    text = plain_text(node).strip()
    if kind == "h" and text:
        return [f"## {text}", ""]
    if kind == "l":
        at = (about.get("li") or f"default-{about['ll']}", about["ll"])
        counts[at] = counts.get(at, 0) + (about["lt"] == "ordered")
        return [("\t" * (about["ll"] - 1) + (f"{counts[at]}. " if about["lt"] == "ordered" else "- ") + text) if text else ""]
    if kind == "h3" and text:
        return [f"### {text}", ""]
    if kind == "hr":
        return ["---", ""]
    if text:
        return [text, ""]
    return [x for child in node.get("5", []) if isinstance(child, dict) for x in plain_blocks(child, counts)]


def test_editor_documents_are_those_of_a_plain_loop(spark):
    rng = random.Random(9)

    def grown(deep):
        node = {"6": rng.choice(["p", "x", "x", "x", "h", "h3", "hr", "im", "l"])}
        if node["6"] == "l":
            node["4"] = {"lt": rng.choice(["ordered", "unordered"]), "ll": rng.randint(1, 3)} | rng.choice([{}, {"li": "a"}])
        if node["6"] == "im":
            node["4"] = rng.choice([{}, {"u": "http://i"}])
        if rng.random() < 0.25:
            node["7"] = [{"8": rng.choice(["", " ", "\u3000", "a ", "b", " 中", 7])} for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.8:
            wide = rng.choice([1, 1, 1, 2, 13])
            node["5"] = [rng.choice([grown(deep - 1)] * 9 + [7, "x"]) for _ in range(wide)] if deep and (wide < 9 or deep < 3) else []
        return node

    def straight(deep):
        node = grown(2)
        for _ in range(deep):
            node = {"6": "x", "5": [node, *([{"6": "p", "7": [{"8": " "}]}] if rng.random() < 0.1 else [])]}
        return node

    trees = [[grown(rng.randint(1, 6)) for _ in range(rng.randint(1, 14))] for _ in range(150)] + [[straight(n), grown(3), straight(n + 1)] for n in range(3 * documents.LEVELS)]
    table = spark.createDataFrame([(i, note(*x)) for i, x in enumerate(trees)], "path long, content string")
    got = {r.path: r.markdown for r in editor_documents(table).collect()}
    for i, tree in enumerate(trees):
        counts = {}
        lines = [x for node in tree for x in plain_blocks(node, counts)]
        spaced = []
        for line in lines:
            item = re.compile(r"^\s*(?:[-*+]|\d+\.)\s+").match
            if spaced and spaced[-1].strip() and item(spaced[-1]) and line.strip() and not item(line):
                spaced.append("")
            spaced.append(line)
        text = re.sub(r"\n{4,}", "\n\n\n", "\n".join(x.rstrip() for x in "\n".join(spaced).split("\n"))).strip()
        assert (got[i] or "") == text, (i, tree)


def test_white_space_is_that_of_patterns(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string")
    around = every.select(F.concat("c", F.lit("x"), "c", F.lit("\n"), "c", F.lit("y"), "c").alias("t"), "c")
    by_pattern = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    lines = F.regexp_replace(F.regexp_replace(F.replace("t", F.lit("\r\n"), F.lit("\n")), r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), r"\n{4,}", "\n\n\n")
    assert around.filter(trimmed(F.col("t")) != by_pattern).count() == 0
    assert around.filter(normal_lines(F.col("t")) != F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")).count() == 0


def nodes_of(spark, **pages):
    return page_nodes(spark.createDataFrame(list(pages.items()), "name string, html string"), "name", "html")


def test_page_content_is_its_sql_where_references_lack_semicolons(spark, tmp_path):
    """HTML decodes some references without a semicolon, the SQL of q_page_content does not."""
    import duckdb

    from gleaner.plans import catalog, conversion  # noqa: F401 (it adds its queries)

    text = "A&amp;&amp b &copy &ampx; &#65 &#65; a & b &amp"
    html = f"<html><head><title>{text}</title><script>a && '&amp'</script></head><body><nav>menu</nav><article><h1>{text}</h1><p>{text} and more</p></article></body></html>".replace("&#65; ", "")
    spark.createDataFrame([(1, "http://x", html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["q_page_content"](spark, str(tmp_path))
    want = con.sql(catalog.ORACLES["q_page_content"])
    assert [tuple(r) for r in got.select(*want.columns).collect()] == want.fetchall()
    page = spark.createDataFrame([("p", f'<p title="&amp &lt;">{text}\ue000</p><script>a && b</script>')], "name string, html string")
    for ended, title, shown in ((True, "&amp <", "A&&amp b &copy &ampx; &#65 A a & b &amp\ue000"), (False, "& <", "A&& b © &x; A A a & b &\ue000")):
        rows = page_nodes(page, "name", "html", ended).orderBy("node").collect()
        assert rows[0].attributes == {"title": title} and [r.text for r in rows if r.tag == ""] == [shown, "a && b"]


def test_nodes_are_balanced(spark):
    got = nodes_of(spark, a="<div><p>one<p>two<b>x</div>tail</i><br></br><hr/><span/>end<!-- c -->more", b="", c=None).orderBy("node").collect()
    assert [(r.node, r.last, r.tag, r.text, [x.tag for x in r.path]) for r in got] == [
        (0, 6, "div", None, []), (1, 6, "p", None, ["div"]), (2, 2, "", "one", ["div", "p"]), (3, 6, "p", None, ["div", "p"]), (4, 4, "", "two", ["div", "p", "p"]), (5, 6, "b", None, ["div", "p", "p"]),
        (6, 6, "", "x", ["div", "p", "p", "b"]), (7, 7, "", "tail", []), (8, 8, "br", None, []), (9, 9, "hr", None, []), (10, 10, "span", None, []), (11, 11, "", "end", []), (12, 12, "", "more", []),
    ]
    assert all(r.page == "a" for r in got)


def test_fields_titles_and_content(spark):
    nodes = nodes_of(
        spark,
        a='<meta property="og:title" content=""><h1 class="x rich_media_title"> T <b>1</b></h1><a id="js_name"> </a><span class="rich_media_meta_nickname">N</span><div class="rich_media_content">no</div><div><div id="js_content">yes<div class="rich_media_content">in</div><p>open</div></div>',
        b='<title>A  &amp; B</title><meta name="twitter:title" content=" tw "><h1>H</h1><div class="article-content">c</div>',
        c="<h1>one <i>two</i></h1>",
        d="plain",
    )
    fields = {(r.page, r.field): r.value for r in fields_of(nodes).collect()}
    assert fields == {("a", "title"): "T1", ("a", "author"): "N", ("b", "title"): "H", ("c", "title"): "onetwo"}
    assert {r.page: r.title for r in titles_of(nodes).collect()} == {"a": "T 1", "b": "tw", "c": "one two"}
    roots = {r.page: r for r in content_of(nodes).collect()}
    inside = {(r.page, r.node): r for r in nodes.collect()}
    assert set(roots) == {"a", "b"} and inside["a", roots["a"].root].attributes["id"] == "js_content" and inside["a", roots["a"].last].text == "open"


def test_richest_is_the_first_of_equals(spark):
    nodes = nodes_of(spark, a="<body><main>" + "x" * 30 + "</main></body>", b="<main>" + "y" * 19 + "</main>", c="<main>" + "z" * 25 + "</main><article>" + "w" * 40 + "<script>" + "v" * 90 + "</script></article>")
    best = richest_of(nodes, [element("article"), element("main"), element("body")])
    tags = {(r.page, r.node): r.tag for r in nodes.collect()}
    assert {r.page: (tags[r.page, r.root], r["length"]) for r in best.collect()} == {"a": ("main", 30), "c": ("article", 40)}


def test_article_inherits_styles(spark):
    body = (
        '<div style="color: rgb(200, 0, 0)">red<span style="color: #00f"><em>blue</em></span><span style="color: #111111">still red</span>'
        '<section style="background-color: rgba(0,0,128,0.9)">dark<i>i</i></section></div>'
        "<blockquote>q<br><p>para <b>graph</b></p><span>free</span></blockquote>"
        "<ul>lost<li>a<div>b <i>c</i></div><ol><li>d<ul><li>e</li></ul></li></ol></li><p>lost</p></ul><ol><li> </li><li>two</li></ol>"
        '<table><tr><td>x</td><td>y<table><tr><td>z</td></tr></table></td></tr></table><pre class="python">pass\n  x</pre><pre><code class="lang-rs">fn</code>rest</pre>'
        '<a href="#top">anchor</a><a href="http://l"><b>link</b></a><a href="http://m"> </a> see http://u/1 and http://u/1 <noscript>n</noscript>'
        '<iframe src="http://v/player?x"></iframe><mpvideo></mpvideo><iframe src="http://ad">shown?</iframe><img src="http://gone/1.png"><h3></h3><h3>H <a href="http://x">3</a></h3>'
        '<img data-src="http://i/1.png" style="width: 50%" width="400"><img src="http://i/1.png" style="width:100px">'
    )
    nodes = nodes_of(spark, a=f'<p>out</p><div id="js_content">{body}</div>', b='<div id="js_content"><script>x</script></div>', c="none")
    images = spark.createDataFrame([("http://i/1.png", "one.png", 800)], "src string, name string, width long")
    got = {r.page: r for r in article_markdown(nodes, content_of(nodes), images).collect()}
    want = (
        '<span style="color:rgb(200, 0, 0)">red</span><span style="color:#00f"><i>blue</i></span><span style="color:rgb(200, 0, 0)">still red</span>'
        '<mark style="background: #000080E5;"><span style="color:rgb(255, 255, 255)">dark</span></mark><mark style="background: #000080E5;"><span style="color:rgb(255, 255, 255)"><i>i</i></span></mark>\n'
        "> q\n\n> paragraph\nfree- a\n- bc\n\t- d\n\t\t- e\n2. two\n\n| x | yz | z |\n| --- | --- | --- |\n| z |  |  |\n\n```python\npass\n  x\n```\n\n```rs\nfn\n```\n"
        "anchor[link](http://l) see [http://u/1](http://u/1) and [http://u/1](http://u/1) \n\n> 🎥 **视频位置 2** - 请在原文中观看\n\n> 🎥 **视频位置 1** - 请在原文中观看\n\n"
    )
    assert got["a"].markdown.startswith(want[:-2])
    rest = got["a"].markdown[len(want) :]
    assert "⚠️ **图片下载失败**" in rest and rest.endswith("### H3\n![[one.png|411]]\n![[one.png|102]]")
    assert (got["a"].images, got["a"].videos) == (2, 2)
    assert got["b"].markdown is None and "c" not in got


def test_marks_are_read_in_one_pass():
    """a container's properties are one pass each: of equal names the first counts, a name without a value is on."""
    from xml.etree import ElementTree

    from gleaner.sources.containers import BOLD, COLOR, ITALIC, STRIKE, WORD, is_on, values

    ns = WORD[1:-1]
    marks = values(ElementTree.fromstring(f'<w:rPr xmlns:w="{ns}"><w:b/><w:i w:val="off"/><w:i/><w:color w:val="ff0080"/><w:color w:val="auto"/></w:rPr>'))
    assert (is_on(marks, BOLD), is_on(marks, ITALIC), is_on(marks, STRIKE), marks[COLOR]) == (True, False, False, "ff0080") and values(None) == {}

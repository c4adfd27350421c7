from pyspark.sql import functions as F

from gleaner.functions import markdown, text


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(c.alias("x")).first().x


def test_bold():
    assert markdown.normal_bold("a **b****c** d") == "a **bc** d"
    assert markdown.normal_bold("plain") == "plain" and markdown.normal_bold("") == ""
    assert markdown.merged_bold("**Q** **：** hi") == "**Q ：** hi"
    assert markdown.normal_bold("x**“y”**z") == "x **“y”** z"
    assert markdown.normal_bold("前文，**：重点**后文") == "前文， **：重点**后文"
    assert markdown.normal_bold("**标题**正文\n- **日期**: x\n  **a** b") == "**标题** 正文\n- **日期**: x\n  **a** b"
    assert markdown.normal_bold("one ** only") == "one ** only"
    assert markdown.normal_bold("a **x,** b **y.**c **z") == "a **x,** b **y.** c **z"
    assert markdown.normal_bold(None) is None


def test_html():
    assert markdown.to_markdown("<h1>T</h1><p>a <b>b</b></p><ul><li>x<ul><li>y</li></ul></li></ul>") == "# T\n\na **b**\n\n- x\n\t- y"
    assert markdown.to_markdown("<script>x</script>") is None
    assert markdown.to_markdown("  ") is None


def test_chunks():
    assert markdown.packed(["aa", "bb", "c" * 7], 6) == ["aa\nbb", "cccccc", "c"]
    assert markdown.packed([], 5) == []
    assert markdown.material_chunks("## 材料 1: a\nx\n## 材料 2: b\ny", 14) == ["## 材料 1: a\nx", "## 材料 2: b\ny"]
    assert markdown.material_chunks("short", 14) == ["short"]
    assert markdown.newline_chunks("aaaa\nbb\ncc", 6) == ["aaaa", "bb\ncc"]
    assert markdown.newline_chunks(" ab ", 6) == [" ab "]
    assert markdown.newline_chunks("x" * 8 + " " * 8 + "y", 8) == ["x" * 8, "y"]


def test_columns(spark):
    note = "- **日期**: 2024-01-05\n- [x] **是否已读**\n# 正文\nbody\nmore\n# AI 评价\nz"
    assert one(spark, text.section(F.col("t"), "正文"), t=note) == "body\nmore\n"
    assert one(spark, text.front_matter(F.col("t"), "日期"), t=note) == "2024-01-05"
    assert one(spark, text.is_read(F.col("t")), t=note) is True
    assert one(spark, text.without_thinking(F.col("t")), t="<think>hidden</think>\n最终答案") == "最终答案"
    assert one(spark, text.item_key(F.lit(" T "), F.lit(""), F.lit("2024-01-02 10:00"))) == "T|2024-01-02"
    assert one(spark, text.key_date(F.lit("a|b|2024-01-02"))) == "2024-01-02"
    assert one(spark, text.joined_distinct(F.array(F.lit(" a"), F.lit("无"), F.lit("b"), F.lit("a")))) == "a, b"
    assert one(spark, text.compact_date(F.lit("2024/03/04"), "2024-01-01")) == "20240304"
    assert one(spark, text.compact_date(F.lit("?"), "2024-01-01")) == "20240101"
    assert one(spark, text.elapsed_text(F.lit(125.9))) == "2m05s"
    assert one(spark, text.seconds_text(F.lit(0))) == "未知"
    assert [one(spark, text.back_off(F.lit(b), F.lit(n), c)) for b, n, c in ((10.0, 1, 1e9), (10.0, 3, 1e9), (30.0, 4, 60.0))] == [10.0, 40.0, 60.0]
    assert one(spark, text.tight_name(F.lit("a:  b. "))) == "a_ b"
    assert one(spark, text.file_name(F.lit("..."))) == "untitled"


def test_headings_of_whole_texts(spark, tmp_path):
    """All headings of a text sink, also those far behind its start, as the original's expressions have it."""
    import re

    from compare import compare

    from gleaner.plans import catalog

    def sunk(md):
        return re.sub(r"(?m)^(#{1,6})(\s+)", lambda m: m[0] if len(m[1]) == 6 else "#" + m[0], md) if re.search(r"(?m)^#\s+", md) else md

    texts = ["x" * 90 + "\n## Two\n#\tTab\n###### Six\n#none\n##### Five", "no heading\r# not a line", "y" * 200 + "\n### Three\n\n# One\n", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.md for r in catalog.QUERIES["q_headings_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: sunk("#" * (1 + i % 3) + " Head\n" + t) for i, t in enumerate(texts)}
    for name in catalog.QUERIES:
        if name.startswith("q_headings"):
            compare(spark, "/root/testdata/sf0.001", catalog.QUERIES[name], catalog.ORACLES[name])

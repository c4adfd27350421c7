import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markdown, notes
from gleaner.operators import digests
from gleaner.operators.digests import digested, materials, packed_blocks
from gleaner.operators.incremental import row_numbers


def plain_chunks(blocks, most):
    """W10 by its rule: fill a chunk while it holds, cut what is larger than a chunk."""
    out, held = [], []
    for b in blocks:
        if held and sum(len(x) for x in held) + len(b) > most:
            out, held = [*out, "\n".join(held).strip()], []
        if len(b) > most:
            out += [b[i : i + most] for i in range(0, len(b), most)]
        else:
            held = [*held, b]
    return [c for c in [*out, "\n".join(held).strip()] if c.strip()]


def test_packing_is_the_same_in_tables_and_lists(spark):
    rng = random.Random(8)
    lists = [["".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 20]))) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    rows = [(k, i, b) for k, blocks in enumerate(lists) for i, b in enumerate(blocks)]
    table = spark.createDataFrame(rows, "key int, place int, text string").repartition(5)
    got = {}
    for r in packed_blocks(table, 8).orderBy("key", "number").collect():
        got.setdefault(r.key, []).append(r.text)
    for k, blocks in enumerate(lists):
        assert plain_chunks(blocks, 8) == markdown.packed(blocks, 8) == got.get(k, [])


def test_materials_keep_numbers_of_empty_ones(spark):
    rows = [("k", 2, "B", "t", "b.md", " two "), ("k", 1, "A", None, "a.md", " \n"), (None, 9, "C", "t", "c.md", "x"), ("k", 3, "D", "t", "d.md", None)]
    docs = spark.createDataFrame(rows, "day string, pos int, title string, kind string, path string, body string").selectExpr("*", "1 AS number", "2 AS key", "3 AS _value", "4 AS text")
    got = [tuple(r) for r in materials(docs, "day", ["pos"], F.col("title"), F.col("kind"), F.col("path"), F.col("body")).orderBy("number").collect()]
    assert sorted(got, key=str) == sorted([("k", 2, "## 材料 2: B\n- 类型: t\n- 文件: b.md\n\ntwo"), (None, 1, "## 材料 1: C\n- 类型: t\n- 文件: c.md\n\nx")], key=str)


def test_rounds_are_as_many_as_lengths_ask_for(spark, monkeypatch):
    """64 parts of 98 characters, chunks of two, summaries of 50 (each with its number's line): 64, 32, 16 and so on."""
    parts = spark.createDataFrame([("a", i, f"{i:04d}" + "x" * 89) for i in range(64)] + [("b", 0, "small"), (None, 0, "nobody's")], "k string, number int, text string")
    first = lambda c: F.concat(F.substring(c, 1, 4), F.lit("|"), F.length(c).cast("string"))
    got = {r.k: (r.text, r.rounds) for r in digested(parts, "k", first, most=200, limit=120).collect()}
    assert got["b"] == ("smal|5", 0) and got[None] == ("nobo|8", 0)
    # Each block is 93 characters and 6 of rule: two in a chunk, 32 chunks of some 16 and 6 characters a summary, nine in a chunk, four chunks.
    chunks = plain_chunks([f"{i:04d}" + "x" * 89 + ("\n\n---\n" if i < 63 else "") for i in range(64)], 200)
    rounds = 1
    while len("\n\n---\n\n".join(said := [f"## 分段 {i}\n\n{c[:4]}|{len(c)}" for i, c in enumerate(chunks, 1)])) > 120:
        chunks = plain_chunks([s + ("\n\n---\n" if i < len(said) - 1 else "") for i, s in enumerate(said)], 200)
        rounds += 1
    whole = "\n\n---\n\n".join(said)
    assert got["a"] == (f"{whole[:4]}|{len(whole)}", rounds) and rounds == 2
    assert digested(parts.limit(0), "k", first).count() == 0
    monkeypatch.setattr(digests, "ROUNDS", 2)
    with pytest.raises(ValueError):
        digested(parts, "k", lambda c: c, most=200, limit=120)


@pytest.mark.parametrize(
    "stem, want",
    [("20260515_策略会", "20260515_策略会"), ("2026-05-15 策略会", "20260515_策略会"), ("策略会20260515", "20260515_策略会"), ("策略会 2026-05-15", "20260515_策略会"), ("251102_公司交流", "20251102_公司交流"), ("202605_月度", "202605_月度"), ("无日期", "20260403_无日期"), ("2026年5月3日 会", "20260503_会"), ("a 2026年5月", "202605_a"), ("20260515", "20260515_20260515")],
)
def test_stems_begin_with_their_date(spark, stem, want):
    row = spark.createDataFrame([(stem,)], "s string").select(notes.dated_stem(F.col("s"), F.lit("2026-04-03").cast("date")).alias("n")).first()
    assert row.n == want


def test_whole_note_edits_put_bold_in_order(spark):
    note = "# 基本信息\n- **行业**: #old\n\n---\n\n# 正文\n\na**“标题”**正文"
    df = spark.createDataFrame([(note,)], "n string")
    r = df.select(notes.tagged_note(F.col("n"), F.array(F.lit("x")), F.array().cast("array<string>")).alias("t"), notes.reviewed_note(F.col("n"), F.lit("good")).alias("r"), notes.reviewed_note(F.col("n"), F.lit("")).alias("same")).first()
    assert "- **行业**: #x" in r.t and "a **“标题”** 正文" in r.t and "a **“标题”** 正文" in r.r and r.r.rstrip().endswith("good") and r.same == note


def test_helper_columns_give_way(spark):
    from gleaner.operators import incremental as inc
    from gleaner.sources.readers import merge_state

    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "s int, n int, v int").selectExpr("*", "8 AS _part", "9 AS _value", "10 AS _of", "11 AS _last", "12 AS _n", "13 AS __x", "14 AS _new", "'k' AS v2")
    sums = inc.running_sum(rows, ["s"], [F.col("n")], F.col("v"), "total").collect()
    assert {(r.s, r.n, r.total, r._part, r._value, r["__x"]) for r in sums} == {(1, 1, 5, 8, 9, 13), (1, 2, 11, 8, 9, 13), (2, 1, 7, 8, 9, 13)}
    got = inc.incremental_select(rows, "s", ["n"], F.col("v") == 5).collect()
    assert {(r.s, r.n, r._of, r._last, r.is_new) for r in got} == {(1, 2, 10, 11, False), (2, 1, 10, 11, True)}
    assert {(r.s, r.n, r._n) for r in inc.newest(rows, ["s"], [F.desc("n")], 1).collect()} == {(1, 2, 12), (2, 1, 12)}
    merged = merge_state(rows.filter("s = 1"), rows.withColumn("v", F.lit(0)), ["s"], "n").collect()
    assert {(r.s, r.v, r._new) for r in merged} == {(1, 0, 14), (2, 0, 14)}


def test_lists_are_spaced_after_lines_of_any_white_space(spark):
    text = "- a\n\t\t\ntext\n- b\ntext\n1. c\n　\n* d\n  + e\nx"
    assert spark.createDataFrame([(text,)], "t string").select(notes.spaced_lists(F.col("t")).alias("o")).first().o == "- a\n\t\t\ntext\n- b\n\ntext\n1. c\n　\n* d\n  + e\n\nx"


def test_texts_are_not_moved_to_be_numbered(spark):
    """what numbers materials joins a written table of a row a key and partition; no shuffle has their texts again."""
    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), i, "x" * rng.randrange(3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "k string, pos int, body string").repartition(4)
    numbered = row_numbers(docs, ["k"], [F.desc("pos")], "number")
    want = {}
    for k, pos, _ in rows:
        want[k] = {p: i for i, p in enumerate(sorted({p for x, p, _ in rows if x == k}, reverse=True), 1)}
    assert all(r.number == want[r.k][r.pos] for r in numbered.collect()) and numbered.count() == len(rows)
    parts = materials(docs, "k", ["pos"], F.lit("t"), F.lit("t"), F.lit("p"), F.col("body"))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (parts, digests.blocks_of(parts, "k", "number", "text"))]
    assert not any("Window" in x or "Exchange hashpartitioning" in x for x in plans)

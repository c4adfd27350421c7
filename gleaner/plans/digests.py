"""Digests end to end, with SQL that gives the same rows. A deterministic stub, which reads all of a text, stands for the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.operators import digests
from gleaner.plans.catalog import query
from gleaner.plans.conversion import strip_sql

MOST, LIMIT = 4000, 1500


def stub(c: Column) -> Column:
    """In place of a model's summary: the text's checksum, length and beginning."""
    return F.concat(F.md5(c), F.lit(" "), F.length(c).cast("string"), F.lit(" "), F.substring(c, 1, 60))


def stub_sql(x: str) -> str:
    return f"(md5({x}) || ' ' || length({x}) || ' ' || substring({x}, 1, 60))"


TOTAL_SQL = "(list_sum(list_transform(blocks, lambda b: length(b) + 1)) - 1)"


@query(rf"""
    WITH RECURSIVE numbered AS (SELECT coalesce(source, '') AS k, doc_id, lang, {strip_sql("coalesce(text, '')")} AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS n FROM documents),
    sections AS (SELECT k, n, max(n) OVER (PARTITION BY k) AS last, '## 材料 ' || n || ': Doc ' || doc_id || chr(10) || '- 类型: ' || coalesce(lang, '') || chr(10) || '- 文件: docs/' || doc_id || '.md' || chr(10) || chr(10) || s AS x FROM numbered WHERE s <> ''),
    rounds(k, round, blocks) AS (
        SELECT k, 0, list(x || CASE WHEN n = last THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) END ORDER BY n) FROM sections GROUP BY k
        UNION ALL SELECT k, round + 1, list_transform(said, lambda x, i: x || CASE WHEN i = len(said) THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) END) FROM (
            SELECT k, round, list_transform(list_filter(chunks, lambda c: {strip_sql("c")} <> ''), lambda c, i: '## 分段 ' || i || chr(10) || chr(10) || {stub_sql("c")}) AS said FROM (
                SELECT k, round, flatten(list_transform(packed, lambda c: CASE WHEN c.n > {MOST} THEN list_transform(range(0, CAST(ceil(c.n / {MOST}.0) AS BIGINT)), lambda i: substring(c.t, i * {MOST} + 1, {MOST})) ELSE [{strip_sql("c.t")}] END)) AS chunks FROM (
                    SELECT k, round, list_reduce(list_transform(blocks, lambda b: [{{'t': b, 'n': length(b)}}]), lambda done, e: CASE WHEN done[-1].n + e[1].n <= {MOST}
                        THEN list_concat(done[1:len(done) - 1], [{{'t': done[-1].t || chr(10) || e[1].t, 'n': done[-1].n + e[1].n}}]) ELSE list_concat(done, e) END) AS packed
                    FROM rounds WHERE {TOTAL_SQL} > {LIMIT}))))
    SELECT k AS source, {stub_sql("array_to_string(blocks, chr(10))")} AS text, CAST(round AS BIGINT) AS rounds FROM rounds WHERE {TOTAL_SQL} <= {LIMIT}""")
def q_digest(t):
    """Each source's documents as materials, summed up in rounds of chunks until they fit."""
    docs = t("documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", "lang", "text")
    doc = F.col("doc_id").cast("string")
    parts = digests.materials(docs, "source", ["doc_id"], F.concat(F.lit("Doc "), doc), F.col("lang"), F.concat(F.lit("docs/"), doc, F.lit(".md")), F.col("text"))
    return digests.digested(parts, "source", stub, MOST, LIMIT)

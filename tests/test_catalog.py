import pytest
from compare import SF, compare

from gleaner.plans import catalog, conversion, digests, notes, records, streams, upkeep  # noqa: F401 (they add their queries)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        compare(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])
    else:
        assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_take_while_is_no_anti_join(spark):
    from pyspark.sql import functions as F

    from gleaner.operators.incremental import take_while_unknown

    rows = spark.createDataFrame([(1, 3, "new"), (1, 2, "old"), (1, 1, "new"), (2, 1, "new")], "s int, n int, k string")
    assert sorted(map(tuple, take_while_unknown(rows, "s", [F.desc("n")], F.col("k") == "old").select("s", "n").collect())) == [(1, 3), (2, 1)]


def test_containment_finds_phrases_of_any_length(spark, monkeypatch):
    from gleaner.operators import incremental as inc

    docs = spark.createDataFrame([(1, "alpha beta gamma delta eps zeta"), (2, "xalpha bet"), (3, None), (4, "")], "id long, t string")
    phrases = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "beta gamma", "beta gamma delta", "lph", "alpha beta gamma delta eps", "nothing", "", None, "beta gamma"])], "n long, p string")
    want = sorted((d.id, q.n) for d in docs.collect() for q in phrases.collect() if d.t and q.p and q.p in d.t)
    for size in (inc.PHRASES, 10):
        monkeypatch.setattr(inc, "PHRASES", size)
        assert sorted((r.id, r.n) for r in inc.containment(docs, "t", phrases, "p").collect()) == want


def test_running_sum_has_no_group_in_one_task(spark):
    from pyspark.sql import functions as F

    from gleaner.operators.incremental import running_sum

    rows = spark.range(1000).selectExpr("if(id < 700, 'hot', if(id < 900, null, 'x')) AS k", "id", "id % 7 AS v").repartition(5)
    for keys in (["k"], []):
        got = {r.id: r.s for r in running_sum(rows, keys, [F.desc("id")], F.col("v"), "s").collect()}
        sums, want = {}, {}
        for r in sorted(rows.collect(), key=lambda r: -r.id):
            sums[r.k if keys else 0] = want[r.id] = sums.get(r.k if keys else 0, 0) + r.v
        assert got == want


def test_entry_without_llm():
    """Where the llm subpackage and the pipeline are missing the entry module still gives all other queries."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name in ("gleaner.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
print(len(e.queries()))
"""
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 90


def test_loose_date_of_large_event_ids(spark, tmp_path):
    """hours counted from event ids of large tables give seconds of eleven digits, as the SQL has them."""
    import duckdb

    spark.range(2_300_000, 36_000_000, 1_000_003).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["q_loose_date"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["q_loose_date"]).fetchall())


def test_style_colour_spaces_before_colours(spark):
    """F8: the spacing is its own step below the colours; in one with them it is more code than the JVM compiles."""
    plan = catalog.QUERIES["q_style_colour"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    spaced = [i for i, line in enumerate(plan) if "padding-top" in line and "regexp_extract" in line and "Project" in line]
    coloured = [i for i, line in enumerate(plan) if "Generate explode" in line]
    assert spaced and coloured and min(spaced) > max(coloured)


def test_html_to_md_hands_over_small_batches(spark):
    """a Python worker holds a batch of pages and their Markdown, so what it holds is bounded by the rows of a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        catalog.QUERIES["q_html_to_md"](spark, SF)
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)

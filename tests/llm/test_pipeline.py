from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import mixing
from test_operators import linked_by_brute_force, plain_queueing

SF = "/root/testdata/sf0.01"


def test_stages(spark, odd):
    from gleaner.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    docs = docs.union(docs.limit(5).selectExpr("doc_id", "text", "lang", "source", "n_chars")).union(docs.limit(4).selectExpr("doc_id + 90000", "text", "lang", "source", "n_chars"))
    docs = docs.union(spark.sql("SELECT 99999L, '123 !!', 'en', 'src1', 6L"))
    docs = written(docs)
    columns = docs.columns
    named = dict(pipeline.STAGES)
    a = written(named["language_id"](spark, docs, SF))
    assert a.columns == columns and a.filter("doc_id = 99999").count() == 0 and a.count() == docs.count() - 1
    b = written(named["exact_dedup"](spark, a, SF))
    best = {}
    for r in a.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert Counter((r.text, r.doc_id) for r in b.collect()) == Counter(best.items())
    c = written(named["simhash_near_dedup"](spark, b, SF))
    want = linked_by_brute_force([(r.doc_id, (r.text or "").lower()) for r in b.collect()])
    gone = {i for i, first in want.items() if i != first}
    assert gone and c.columns == columns and Counter(r.doc_id for r in c.collect()) == Counter(r.doc_id for r in b.collect() if r.doc_id not in gone)
    d = written(named["mixing"](spark, c, SF))
    sized = c.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(7)).alias("spot"))
    target = {r.source: r.target for r in mixing.targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).collect()}
    want = plain_queueing([(r.doc_id, r.source, r["size"], r.spot, target[r.source]) for r in sized.collect()])
    assert d.columns == columns and Counter(r.doc_id for r in d.collect()) == +want and max(want.values()) <= 2
    e = named["bpe_codec"](spark, d, SF)
    assert e.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "same"]
    codec = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    text = {r.doc_id: r.text for r in d.collect()}
    rows = e.collect()
    assert len(rows) == d.count()
    for r in rows:
        assert r.same and r.n_tokens == len(r.token_ids) and r.token_ids == codec.encode(text[r.doc_id] or "", add_special_tokens=False).ids


def test_odd_rows(spark, odd):
    from gleaner.llm.shared import written

    docs = odd
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        if name != "bpe_codec":
            assert docs.columns == odd.columns
    assert docs.count() > 0
    docs = odd.limit(0)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    assert docs.count() == 0

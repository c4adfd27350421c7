"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe_codec, exact_dedup, language_id, mixing, near_copies
from gleaner.llm.shared import dropping, scratch, small_batches, table, written

TOKENIZER = "byte_bpe_50k.json"
#: A text is rejected if no language reaches this share of its words.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or have no language of LEAST_SCORE; an empty table stays empty, repeated rows all stay."""
    small_batches(spark)
    said = language_id.language(F.col("text"), language_id.fitted(docs), spark)
    judged = docs.select(F.struct(*docs.columns).alias("row"), said.alias("said"))
    return judged.filter((F.col("said.lang") != language_id.UNKNOWN) & (F.col("said.score") >= LEAST_SCORE)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) the row with the largest doc_id stays, a null doc_id only where there is no other.

    Of rows that repeat both, the one whose columns sort first stays. An empty table stays empty.
    """
    small_batches(spark)
    found = written(exact_dedup.exact_duplicates(docs))
    key = ["id", "sha"]
    named = [F.coalesce("doc_id", F.lit(exact_dedup.LOWEST)).alias("id"), F.unhex("text_sha256").alias("sha")]
    marks = written(found.filter("group_size > 1").select(*named, "kept").groupBy(*key).agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(exact_dedup.LOWEST)).alias("id"), sha.alias("sha"))
    out = dropping(keyed, written(marks.filter("not kept or n > 1").select(*key)), key)
    repeated = marks.filter("kept and n > 1").select(*key)
    if repeated.head(1):
        again = keyed.join(repeated, key, "left_semi").groupBy(*key).agg(F.min("row").alias("row"))
        out = out.select("row").unionByName(again.select("row"))
    return out.select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles, the one with the smallest doc_id stays.

    Pairs come from SimHash fingerprints by operator 3's index (at most 2 of 64 bits differ), and from its wider form for those that differ in
    more bits; all are verified on their shingles.
    Null, empty and wordless texts link to nothing and stay, as do rows without a doc_id; rows of one doc_id are one document. An empty table
    stays empty.
    """
    small_batches(spark)
    gone = written(near_copies.near_copies(docs).filter("doc_id <> component_id").select("doc_id"))
    return dropping(docs, gone, "doc_id").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, of whole documents: each row as often as it is taken, up to twice.

    A null source is a source; null and empty texts have no words and come in once, if their place in the queue is before the cut. Rows that
    repeat doc_id, source and text share what was taken of them, rounded. An empty table stays empty.
    """
    row = F.struct(*docs.columns)
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    taken = mixing.mixed(sized, whole=True).groupBy("doc_id", "source", "mark").agg(F.count("*").alias("_times"), F.countDistinct("epoch").alias("_epochs"))
    # Rows that repeat doc_id, source and text share what was taken of them; each comes in as often as its share, rounded.
    share = F.greatest(F.lit(1), F.col("_epochs"))
    joined = docs.select(row.alias("_row"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_m")).join(
        taken.select("doc_id", F.col("source").alias("_of"), "mark", share.alias("_share")),
        F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_m") == F.col("mark")),
    )
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_share").cast("int")))).select("_row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text."""
    small_batches(spark)
    return bpe_codec.encode_checked(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage), ("mixing", mixing_stage), ("bpe_codec", encoding_stage)]

#: SQL has neither the field of the first stage nor BPE; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What the stages write on their way goes with each stage; their results go when the driver ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), outside=True)
    return docs

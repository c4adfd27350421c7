"""Queries that run a stream over what is there and return its state, with SQL for the batch that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.incremental import running_sum
from gleaner.plans.catalog import ORACLES, QUERIES
from gleaner.sources import paged
from gleaner.sources.readers import table, work_folder
from gleaner.streaming import stateful


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as the table may be one file, which Spark takes for a stream's folder otherwise.
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def s_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T10."""
    folder = work_folder(spark)
    rows = events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    stateful.upsert_stream(rows, ["user_id", "event_type"], "event_id", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return stateful.latest_version(spark, f"{folder}/state")


def s_cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the watermark of all rows closes the breakers of users who fell silent."""
    folder = work_folder(spark)
    rows = events(spark, sf_dir).selectExpr("user_id", "event_type", "CAST(ts AS TIMESTAMP) AS ts")
    return stateful.last_states(stateful.cooldown_stream(rows), ["user_id"], f"{folder}/states", f"{folder}/checkpoint")


def s_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark (the largest ts, less an hour) has passed are closed."""
    folder = work_folder(spark)
    rows = events(spark, sf_dir).selectExpr("CAST(user_id AS LONG) AS user_id", "event_type", "CAST(ts AS TIMESTAMP) AS ts")
    with stateful.many_states(spark):
        return stateful.last_states(stateful.daily_quota(rows, 3), ["user_id", "day"], f"{folder}/states", f"{folder}/checkpoint")


#: Items of a landed page, and of each of the first two runs; the third takes the rest.
PAGE_ITEMS, RUN_ITEMS = 200, 300


def s_paged_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents are as landed pages of a listing, newest first; the first quarter of the ids is known; three runs, each anew."""
    folder = work_folder(spark)
    rows = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS LONG) AS doc_id", "lang", "CAST(coalesce(length(text), 0) AS LONG) AS size")
    placed = running_sum(rows, [], [F.desc("doc_id")], F.lit(1), "place").withColumn("page", F.floor((F.col("place") - 1) / PAGE_ITEMS) + 1)
    placed.repartitionByRange("page").sortWithinPartitions("page", "place").drop("place").write.partitionBy("page").json(f"{folder}/pages")
    known = rows.selectExpr("min(doc_id) + (max(doc_id) - min(doc_id)) DIV 4 AS mark").first().mark
    source, schema = paged.paged_source("landed_pages", paged.LandedPages), "doc_id long, lang string, size long"
    for most in (RUN_ITEMS, RUN_ITEMS, 0):
        paged.pull(
            spark, source, schema, ["doc_id"], f"{folder}/state", f"{folder}/checkpoint", None if known is None else [known], most,
            path=f"{folder}/pages", tasks=str(spark.sparkContext.defaultParallelism),
        )
    return paged.pulled(spark, f"{folder}/state", schema)


QUERIES |= {f.__name__: f for f in (s_upsert_stream, s_cooldown_stream, s_daily_quota, s_paged_pull)}
ORACLES |= {
    "s_paged_pull": f"""
        SELECT doc_id, lang, size, least((row_number() OVER (ORDER BY doc_id) - 1) // {RUN_ITEMS}, 2) AS run FROM (
            SELECT doc_id, lang, coalesce(length(text), 0) AS size FROM documents) WHERE doc_id > (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 4 FROM documents)""",
    "s_daily_quota": """
        SELECT user_id, day, used, errors, greatest(0, 3 - used) AS remaining, day + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS open FROM (
            SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS used, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id, CAST(ts AS DATE))""",
    "s_upsert_stream": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "s_cooldown_stream": """
        WITH m AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS miss FROM events GROUP BY user_id),
        s AS (SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (miss IS NULL OR ts > miss)) AS streak, max(ts) FILTER (event_type = 'error') AS last FROM events e JOIN m ON e.user_id = m.user_id GROUP BY e.user_id)
        SELECT user_id, streak, coalesce(streak >= 3 AND last + INTERVAL 600 SECOND > (SELECT max(ts) FROM events), false) AS open FROM s""",
}

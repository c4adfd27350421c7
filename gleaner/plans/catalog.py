"""The named queries over the fixture tables, each with SQL that gives the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import markdown, text
from gleaner.operators import incremental as inc
from gleaner.sources.readers import small_batches, table

AS_OF, WEEK = "2024-01-31", "2024-01-17"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def newest_orders() -> list:
    return [F.desc("o_orderdate"), F.desc("o_orderkey")]


@query("""
    WITH m AS (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS seen,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos,
        max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) = 0 AS is_new FROM orders)
    SELECT o_custkey, o_orderkey, c_mktsegment, pos, is_new FROM m JOIN customer ON o_custkey = c_custkey
    WHERE seen = 0 AND pos <= CASE WHEN is_new THEN 3 ELSE 10 END""")
def q_incremental_select(t):
    chosen = inc.incremental_select(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")
    return chosen.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "c_mktsegment", "pos", "is_new")


@query("""
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'F') WHERE n <= 5""")
def q_incremental_override(t):
    orders = t("orders")
    return inc.unprocessed(orders, orders.filter("o_orderstatus = 'F'"), "o_orderkey", "o_custkey", 5, newest_orders()).select("o_custkey", "o_orderkey")


@query("""
    WITH k AS (SELECT DISTINCT user_id, event_type || '|' || strftime(ts, '%Y-%m-%d') AS item_key FROM events)
    SELECT user_id, item_key FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY split_part(item_key, '|', 2) DESC, item_key) AS n FROM k) WHERE n <= 20""")
def q_history_bounded(t):
    keys = t("events").select("user_id", text.item_key(F.col("event_type"), F.date_format("ts", "yyyy-MM-dd"), F.lit(None).cast("string")).alias("item_key")).distinct()
    return inc.newest(keys, ["user_id"], [text.key_date(F.col("item_key")).desc(), F.col("item_key")], 20)


@query("""
    WITH f AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT user_id, event_id FROM f ORDER BY event_id DESC LIMIT 50""")
def q_keep_last_n(t):
    return t("events").filter("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id")).orderBy(F.desc("event_id")).limit(50)


@query("""
    SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS transitions, min(event_id) AS first_at, max(event_id) AS last_at FROM events GROUP BY user_id, event_type""")
def q_task_state_latest(t):
    return inc.latest_state(t("events"), ["user_id", "event_type"], ["event_id"], ["value"])


@query("""
    SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20""")
def q_task_transitions_last20(t):
    return inc.newest(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20, "n").select("user_id", "event_id", "n")


@query(f"""
    WITH s AS (SELECT user_id, event_type, max(ts) AS last_at, max(event_id) AS last_id FROM events GROUP BY user_id, event_type)
    SELECT user_id, event_type, last_id FROM s WHERE date_diff('day', CAST(last_at AS DATE), DATE '{AS_OF}') <= 7 OR event_type = 'error' ORDER BY last_at DESC, last_id DESC LIMIT 500""")
def q_state_prune(t):
    state = t("events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_at"), F.max("event_id").alias("last_id"))
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("last_at").cast("date"))
    return inc.pruned(state, age, F.col("event_type") == "error", 500, [F.desc("last_at"), F.desc("last_id")], 7).select("user_id", "event_type", "last_id")


@query("""
    WITH h AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS stamp FROM events)
    SELECT event_id, stamp FROM h WHERE try_cast(stamp AS DATE) IS NULL OR date_diff('day', CAST(stamp AS DATE), DATE '2024-01-31') <= 10""".replace("CAST(stamp AS DATE), DATE", "try_cast(stamp AS DATE), DATE"))
def q_ttl_history(t):
    history = t("events").select("event_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("stamp"))
    age = F.datediff(F.lit(AS_OF).cast("date"), F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd")).cast("date"))
    return history.filter(age.isNull() | (age <= 10))


@query("""
    WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM r GROUP BY user_id, run, event_type""")
def q_speaker_runs(t):
    numbered = inc.runs(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return numbered.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"), ids.alias("ids"))


@query("""
    SELECT conv_id, string_agg('**' || CASE role WHEN 'user' THEN 'Guest' WHEN 'assistant' THEN 'Host' ELSE '发言人' || role END || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript
    FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def q_transcript_render(t):
    names = {"user": "Guest", "assistant": "Host"}
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("role")), F.concat(F.lit("发言人"), F.col("role")))
    lines = t("conversations").filter(F.trim("text") != "").select("conv_id", "turn", F.concat(F.lit("**"), name, F.lit("**: "), F.col("text")).alias("line"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n").alias("transcript"))


@query("""
    WITH m AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN event_id END) AS miss FROM events GROUP BY user_id)
    SELECT e.user_id, count(CASE WHEN m.miss IS NULL OR e.event_id > m.miss THEN 1 END) AS streak, count(CASE WHEN m.miss IS NULL OR e.event_id > m.miss THEN 1 END) >= 3 AS cooling
    FROM events e JOIN m ON e.user_id = m.user_id GROUP BY e.user_id""")
def q_error_streak(t):
    return inc.trailing_streak(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "error").withColumn("cooling", F.col("streak") >= 3)


@query(f"""
    WITH p AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{AS_OF}'), m AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN event_id END) AS miss, max(CASE WHEN event_type = 'error' THEN ts END) AS last FROM p GROUP BY user_id),
    s AS (SELECT p.user_id, count(CASE WHEN m.miss IS NULL OR p.event_id > m.miss THEN 1 END) AS streak, max(m.last) AS last FROM p JOIN m ON p.user_id = m.user_id GROUP BY p.user_id)
    SELECT user_id, streak, streak >= 3 AND coalesce(last > TIMESTAMP '{AS_OF}' - INTERVAL 300 SECOND, false) AS cooling FROM s""")
def q_error_cooldown(t):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return inc.cooling(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "event_id", "ts", F.col("event_type") == "error", as_of)


@query("""
    SELECT user_id, count(*) AS calls, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases,
        round(CAST(count(CASE WHEN event_type <> 'error' THEN 1 END) AS DOUBLE) / count(*), 6) AS success_rate,
        round(avg(CASE WHEN event_type <> 'error' AND value <= 120 THEN value END), 6) AS mean_value FROM events GROUP BY user_id""")
def q_call_stats(t):
    kind, ok = F.col("event_type"), F.col("event_type") != "error"
    return t("events").groupBy("user_id").agg(
        F.count("*").alias("calls"), F.count(F.when(kind == "error", 1)).alias("errors"), F.count(F.when(kind == "purchase", 1)).alias("purchases"),
        F.round(F.count(F.when(ok, 1)).cast("double") / F.count("*"), 6).alias("success_rate"), F.round(F.avg(F.when(ok & (F.col("value") <= 120), F.col("value"))), 6).alias("mean_value"),
    )


@query("""
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_reduce(list(value ORDER BY event_id), lambda a, x: (a + x) / 2) AS half_avg FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""")
def q_running_half_average(t):
    return inc.running_half(t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["user_id", "day"], "event_id", "value")


@query("""
    SELECT c_mktsegment, c_nationkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS success, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS failed, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((), (c_mktsegment), (c_nationkey))""")
def q_download_stats(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    done = F.col("o_orderstatus") == "F"
    return joined.groupingSets([[], ["c_mktsegment"], ["c_nationkey"]], "c_mktsegment", "c_nationkey").agg(F.count(F.when(done, 1)).alias("success"), F.count(F.when(~done, 1)).alias("failed"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT o_custkey, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS success, count(*) - count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS failed,
        string_agg(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey) AS failed_ids, min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS resume_at FROM orders GROUP BY o_custkey""")
def q_step_summary(t):
    done = F.col("o_orderstatus") == "F"
    ids = F.array_sort(F.collect_list(F.when(~done, F.col("o_orderkey"))))
    return t("orders").groupBy("o_custkey").agg(
        F.count("*").alias("total"), F.count(F.when(done, 1)).alias("success"), (F.count("*") - F.count(F.when(done, 1))).alias("failed"),
        F.when(F.size(ids) > 0, F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("failed_ids"), F.min(F.when(~done, F.col("o_orderkey"))).alias("resume_at"),
    )


@query("SELECT event_type, count(*) AS n, count(CASE WHEN value > 10 THEN 1 END) AS downloaded FROM events GROUP BY ROLLUP (event_type)")
def q_tag_rollup(t):
    return t("events").rollup("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 10, 1)).alias("downloaded"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_name = 'NATION_' || r_regionkey")
def q_account_match(t):
    config = t("region").withColumn("key", F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")))
    return t("nation").join(config, F.col("n_name") == F.col("key")).select("n_nationkey", "n_name", "r_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT 'NATION_' || r_regionkey FROM region)")
def q_account_unmatched(t):
    config = t("region").select(F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("n_name"))
    return t("nation").join(config, "n_name", "left_anti").select("n_nationkey", "n_name")


@query("""
    WITH q AS (SELECT c_custkey, CAST(c_custkey % 150 AS VARCHAR) AS wanted FROM customer)
    SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM q JOIN supplier ON wanted = CAST(s_suppkey AS VARCHAR) OR wanted = CAST(s_nationkey AS VARCHAR) GROUP BY c_custkey""")
def q_single_match(t):
    wanted = t("customer").select("c_custkey", (F.col("c_custkey") % 150).cast("string").alias("wanted"))
    # An OR-join as an equi-join on any of the row's names.
    names = t("supplier").select("s_suppkey", F.explode(F.array_distinct(F.array(F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")))).alias("wanted"))
    return wanted.join(names.groupBy("wanted").agg(F.min("s_suppkey").alias("s_suppkey")), "wanted").select("c_custkey", "s_suppkey")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN '未知' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_left_meta(t):
    labels = t("labels").withColumn("has", F.lit(True))
    status = F.when(F.col("has").isNull(), "未知").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return t("documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), status.alias("status"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_unprocessed(t):
    return inc.unprocessed(t("documents").select("doc_id", "n_chars"), t("labels"), "doc_id")


LINKS_SQL = "l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS target FROM pages), c AS (SELECT target, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM l GROUP BY target)"


def links(t):
    found = t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("target"))
    return found, found.groupBy("target").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(f"WITH {LINKS_SQL} SELECT target, pages, first_page FROM c WHERE pages > 1")
def q_ref_elsewhere(t):
    return links(t)[1].filter("pages > 1")


@query(f"WITH {LINKS_SQL} SELECT target || '#' || (page_id % 120) AS ref, min(page_id) AS only_page FROM l GROUP BY target || '#' || (page_id % 120) HAVING count(*) = 1")
def q_orphans(t):
    refs = links(t)[0].withColumn("ref", F.concat("target", F.lit("#"), (F.col("page_id") % 120).cast("string")))
    return refs.groupBy("ref").agg(F.min("page_id").alias("only_page"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("""
    WITH o AS (SELECT DISTINCT p_brand AS opt FROM part), tok AS (SELECT DISTINCT p_partkey, 'Brand#' || (p_size % 30) AS token FROM part),
    m AS (SELECT p_partkey, token, opt, CASE WHEN token = opt THEN 0 ELSE 1 END AS fuzzy FROM tok JOIN o ON token = opt OR contains(token, opt) OR contains(opt, token))
    SELECT p_partkey, token, opt FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY fuzzy, length(opt) DESC, opt) AS n FROM m) WHERE n = 1""")
def q_fuzzy_tag(t):
    options = t("part").select(F.col("p_brand").alias("opt")).distinct()
    tokens = t("part").select("p_partkey", F.concat(F.lit("Brand#"), (F.col("p_size") % 30).cast("string")).alias("token"))
    # Tokens repeat: distinct ones (few) are matched with the options (an allowed list, few) by their containment, then joined back.
    parts = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(i, F.length(c)), lambda j: F.substring(c, i, j - i + 1))))
    distinct = tokens.select("token").distinct()
    inside = distinct.select("token", F.explode(F.array_distinct(parts(F.col("token")))).alias("opt")).join(options, "opt")
    around = options.select("opt", F.explode(F.array_distinct(parts(F.col("opt")))).alias("token")).join(distinct, "token").select("token", "opt")
    best = inside.select("token", "opt").union(around).groupBy("token").agg(F.min_by("opt", F.struct((F.col("token") != F.col("opt")).alias("f"), -F.length("opt"), "opt")).alias("opt"))
    return tokens.join(best, "token").select("p_partkey", "token", "opt")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_containment(t):
    return inc.containment(t("documents").select("doc_id", "text"), "text", t("benchmark").select("item_id", F.col("text").alias("phrase")), "phrase").select("doc_id", "item_id")


@query(f"SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) BETWEEN CAST(date_trunc('week', DATE '{WEEK}') AS DATE) AND CAST(date_trunc('week', DATE '{WEEK}') + INTERVAL 6 DAY AS DATE)")
def q_week_membership(t):
    first = text.monday(F.lit(WEEK).cast("date"))
    return t("events").filter(F.col("ts").cast("date").between(first, F.date_add(first, 6))).select("event_id", "user_id")


@query(f"""
    SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) AS n FROM (SELECT user_id, min(event_id) AS event_id FROM events
    WHERE CAST(ts AS DATE) = DATE '{WEEK}' AND event_type IN ('view', 'click', 'purchase') GROUP BY user_id)""")
def q_daily_digest_docs(t):
    day = t("events").filter((F.col("ts").cast("date") == F.lit(WEEK).cast("date")) & F.col("event_type").isin("view", "click", "purchase"))
    one = day.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return inc.running_sum(one, [], [F.col("user_id"), F.col("event_id")], F.lit(1).cast("long"), "n")


@query("""
    SELECT user_id, 'day' AS kind, strftime(ts, '%Y-%m-%d') AS period, min(event_id) AS claimed_at, count(*) AS attempts FROM events WHERE event_type = 'purchase' GROUP BY user_id, strftime(ts, '%Y-%m-%d')
    UNION ALL SELECT user_id, 'week', strftime(date_trunc('week', ts), '%Y-%m-%d'), min(event_id), count(*) FROM events WHERE event_type = 'purchase' GROUP BY user_id, strftime(date_trunc('week', ts), '%Y-%m-%d')""")
def q_first_run_claims(t):
    periods = {"day": F.date_format("ts", "yyyy-MM-dd"), "week": F.date_format(text.monday(F.col("ts")), "yyyy-MM-dd")}
    parts = [inc.first_claims(t("events").withColumn("kind", F.lit(k)), ["user_id", "kind"], p, "event_id", F.col("event_type") == "purchase") for k, p in periods.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(text)")
def q_dedupe_keep_first(t):
    return t("documents").groupBy(F.sha2(F.lower("text"), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query("""
    SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'skipped_no_url' WHEN NOT contains(url, '.example.com') THEN 'skipped_other_host' WHEN contains(url, 'utm_source') THEN 'skipped_tracking' WHEN length(html) < 1000 THEN 'skipped_short' ELSE 'accepted' END AS disposition FROM pages""")
def q_disposition(t):
    url = F.col("url")
    kind = F.when(url.isNull() | (url == ""), "skipped_no_url").when(~url.contains(".example.com"), "skipped_other_host").when(url.contains("utm_source"), "skipped_tracking").when(F.length("html") < 1000, "skipped_short").otherwise("accepted")
    return t("pages").select("page_id", kind.alias("disposition"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS DISTINCT FROM 1")
def q_pending_null_safe(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").filter(~F.col("quality").eqNullSafe(F.lit(1))).select("doc_id")


@query("""
    SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 500 THEN 'too_short' WHEN contains(lower(text), 'pathetic') THEN 'refusal' ELSE '' END AS reason, NOT (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 500 OR contains(lower(text), 'pathetic')) AS ok FROM documents""")
def q_quality_gate(t):
    return t("documents").select("doc_id", text.quality(F.col("text"), 500, ("pathetic",)).alias("q")).select("doc_id", "q.reason", "q.ok")


@query("""
    SELECT event_id, CASE WHEN contains(lower(event_type || props), 'error') AND value > 100 THEN 'slow_error' WHEN contains(lower(event_type || props), 'error') THEN 'error' WHEN contains(lower(event_type || props), '"k": 9') THEN 'nine' ELSE 'unknown' END AS rule FROM events""")
def q_error_rules(t):
    said = F.concat(F.when(F.col("value") > 100, "slow ").otherwise(""), F.col("event_type"), F.col("props"))
    return t("events").select("event_id", text.first_rule(said, [("slow error", "slow_error"), ("error", "error"), ('"k": 9', "nine")], "unknown").alias("rule"))


@query("""
    SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def q_url_parts(t):
    url = F.col("url")
    page = F.regexp_extract(text.url_part(url, "query"), r"(?:^|&)page=([^&]*)", 1)
    return t("pages").select("page_id", *[text.url_part(url, p).alias(p) for p in ("scheme", "host", "path", "fragment")], page.alias("page"))


@query("""
    SELECT page_id, substring(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')), 1, 200) AS title FROM pages""")
def q_page_title(t):
    return t("pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("""
    WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS a FROM pages), u AS (SELECT page_id, unnest(a) AS target, unnest(range(1, len(a) + 1)) AS i FROM l),
    f AS (SELECT page_id, target, min(i) AS i FROM u GROUP BY page_id, target) SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos FROM f""")
def q_page_links(t):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return t("pages").select("page_id", F.posexplode(found).alias("p", "target")).select("page_id", "target", (F.col("p") + 1).cast("long").alias("pos"))


@query()
def q_html_to_md(t):
    pages = t("pages")
    small_batches(pages.sparkSession)  # of pages of any size a worker holds a batch, and what becomes of it
    md = markdown.html_to_markdown(F.col("html"))
    return pages.select("page_id", md.alias("md")).select("page_id", F.length("md").cast("long").alias("n_chars"), F.sha2("md", 256).alias("md_sha256"))


@query("""
    SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y%m%d') || '_' || source || '_' || coalesce(nullif(substring(regexp_replace(trim(regexp_replace(split_part(text, chr(10), 1), '[<>:"/\\\\|?*]', '_', 'g')), '[.]+$', ''), 1, 100), ''), 'untitled') || '.md' AS name FROM documents""")
def q_sanitize_name(t):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyyMMdd")
    return t("documents").select("doc_id", F.concat(day, F.lit("_"), "source", F.lit("_"), text.file_name(F.substring_index("text", "\n", 1)), F.lit(".md")).alias("name"))


@query("""
    SELECT p_partkey, CASE WHEN n = 0 THEN p_name ELSE p_name || '_' || n END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)""")
def q_unique_names(t):
    return inc.suffixed(t("part").select("p_partkey", "p_name"), "p_name", [F.col("p_partkey")]).select("p_partkey", "unique_name")


@query("SELECT doc_id, i AS pos, substring(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS i FROM documents)")
def q_fixed_chunks(t):
    return t("documents").select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"), 2000)).alias("p", "chunk")).select("doc_id", F.col("p").cast("long").alias("pos"), "chunk")


@query("SELECT source, n // 50 AS batch, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY source, n // 50")
def q_batches(t):
    numbered = inc.running_sum(t("documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], F.lit(1).cast("long"), "n")
    return numbered.withColumn("batch", F.floor((F.col("n") - 1) / 50)).groupBy("source", "batch").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query()
def q_greedy_pack(t):
    chunks = markdown.paragraphs_packed(F.col("text"), 4000)
    return t("documents").select("doc_id", chunks.alias("c")).select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.array_join("c", "\x1e"), 256).alias("chunks_sha256"))


@query()
def q_newline_chunks(t):
    chunks = markdown.newline_chunked(F.col("text"), 3000)
    return t("documents").select("doc_id", "text", chunks.alias("c")).select("doc_id", F.size("c").cast("long").alias("n_chunks"), (F.array_join("c", "") == F.col("text")).alias("whole"))


@query()
def q_md_normalize(t):
    return t("documents").filter(F.col("text").contains("**")).select("doc_id", markdown.bold_normalised(F.col("text")).alias("md"))


@query("""
    WITH h AS (SELECT doc_id, repeat('#', CAST(1 + doc_id % 3 AS INTEGER)) || ' Head' || chr(10) || substring(text, 1, 80) AS md FROM documents)
    SELECT doc_id, CASE WHEN md LIKE '# %' THEN '#' || md ELSE md END AS md FROM h""")
def q_headings(t):
    md = F.concat(F.repeat(F.lit("#"), (1 + F.col("doc_id") % 3).cast("int")), F.lit(" Head\n"), F.substring("text", 1, 80))
    return t("documents").select("doc_id", text.demoted_headings(md).alias("md"))


@query("""
    WITH h AS (SELECT doc_id, repeat('#', CAST(1 + doc_id % 3 AS INTEGER)) || ' Head' || chr(10) || text AS md FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(md, '(?m)^#\\s') THEN regexp_replace(md, '(?m)^(#{1,5})(\\s)', '#\\1\\2', 'g') ELSE md END AS md FROM h""")
def q_headings_whole(t):
    md = F.concat(F.repeat(F.lit("#"), (1 + F.col("doc_id") % 3).cast("int")), F.lit(" Head\n"), "text")
    return t("documents").select("doc_id", text.demoted_headings(md).alias("md"))


@query("""
    WITH s AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10)) AS x FROM documents)
    SELECT doc_id, CAST(length(regexp_replace(regexp_replace(regexp_replace(x, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g'), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS two,
        CAST(length(regexp_replace(regexp_replace(regexp_replace(x, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', repeat(chr(10), 2), 'g'), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS one FROM s""")
def q_blank_squeeze(t):
    x = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n\n"))
    return t("documents").select("doc_id", F.length(text.squeezed_lines(x, 2)).cast("long").alias("two"), F.length(text.squeezed_lines(x, 1)).cast("long").alias("one"))


@query("SELECT doc_id, regexp_replace(replace(trim(text), '|', '\\|'), '\\r?\\n', '<br>', 'g') AS cell FROM documents WHERE contains(text, '|')")
def q_table_cells(t):
    return t("documents").filter(F.col("text").contains("|")).select("doc_id", text.table_cell(F.col("text")).alias("cell"))


@query("""
    SELECT o_orderkey, CASE WHEN s <= 0 THEN '未知' WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
        ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration FROM (SELECT o_orderkey, o_orderkey % 9000 AS s FROM orders)""")
def q_duration_fmt(t):
    return t("orders").select("o_orderkey", text.seconds_text(F.col("o_orderkey") % 9000).alias("duration"))


@query("SELECT o_orderkey, round(least(10.0 * pow(2, o_orderkey % 8), 600.0), 1) AS delay FROM orders")
def q_backoff(t):
    return t("orders").select("o_orderkey", text.back_off(F.lit(10.0), F.col("o_orderkey") % 8 + 1, 600.0).alias("delay"))


LIN = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(f"""
    WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part), l AS (SELECT *, 0.2126 * ({LIN.format('r')}) + 0.7152 * ({LIN.format('g')}) + 0.0722 * ({LIN.format('b')}) AS y FROM c)
    SELECT p_partkey, round(y, 6) AS luminance, 1.05 / (y + 0.05) < 4.5 AS dark_text, lower(printf('#%02x%02x%02x', r, g, b)) AS hex FROM l""")
def q_colour_rules(t):
    r, g, b = (F.col("p_partkey") * k % 256 for k in (1, 7, 13))
    y = text.luminance(r, g, b)
    return t("part").select("p_partkey", F.round(y, 6).alias("luminance"), (text.contrast(F.lit(1.0), y) < 4.5).alias("dark_text"), F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(x), 2, "0") for x in (r, g, b)])).alias("hex"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(CASE WHEN event_id % 11 = 0 THEN '{bad' WHEN event_id % 13 = 0 THEN '{}' ELSE props END, '$.k') AS BIGINT), -1) AS k FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 11 = 0")
def q_json_props(t):
    props = F.when(F.col("event_id") % 11 == 0, "{bad").when(F.col("event_id") % 13 == 0, "{}").otherwise(F.col("props"))
    return t("events").select("event_id", F.coalesce(F.get_json_object(props, "$.k").try_cast("long"), F.lit(-1)).alias("k"))


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5")
def q_topn_per_dir(t):
    return inc.newest(t("documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5, "n").select("source", "doc_id", "n")


@query("SELECT o_custkey, max(o_orderdate) AS latest_at, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest_key FROM orders GROUP BY o_custkey".replace("max_by(o_orderkey, (o_orderdate, o_orderkey))", "arg_max(o_orderkey, row(o_orderdate, o_orderkey))"))
def q_latest(t):
    return t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest_at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_key"))


@query("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 50000")
def q_cumulative_trim(t):
    return inc.cumulative_trim(t("documents").select("source", "doc_id", "n_chars"), "source", [F.desc("doc_id")], F.col("n_chars"), 100_000).select("source", "doc_id", F.col("used").cast("long").alias("used"))


@query("""
    SELECT doc_id, string_agg(substring(chunk, 1, 40), chr(10) ORDER BY i) AS digest FROM (SELECT doc_id, i, substring(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS i FROM documents)) GROUP BY doc_id""")
def q_summarise_stub(t):
    digest = F.array_join(F.transform(text.fixed_chunks(F.col("text"), 2000), lambda x: F.substring(x, 1, 40)), "\n")
    return t("documents").filter(F.length("text") > 0).select("doc_id", digest.alias("digest"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def q_item_totals(t):
    items = t("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(paid), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))

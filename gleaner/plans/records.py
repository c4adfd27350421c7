"""Queries over records: payloads, properties, accounts, recycling, retries and clean-up plans, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import records as rec
from gleaner.plans.catalog import query
from gleaner.sources.readers import settings

AS_OF = "2024-01-31"
#: A line's place in its order, alone.
PLACE = "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)"


@query("""
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'http://x/' || s_suppkey ELSE 'http://y/' || s_suppkey END AS url, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE s_name END AS name,
        CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'S' || s_suppkey ELSE s_name END AS short_name FROM supplier""")
def q_account(t):
    """P5."""
    record = "CASE s_suppkey % 3 WHEN 0 THEN 'http://x/' || s_suppkey WHEN 1 THEN '{\"url\": \" http://y/' || s_suppkey || '\", \"name\": \"' || s_name || '\", \"short_name\": \"S' || s_suppkey || ' \"}' ELSE '{\"url\": \"http://y/' || s_suppkey || '\", \"name\": \"' || s_name || '\"}' END"
    return t("supplier").select("s_suppkey", rec.account(F.expr(record)).alias("a")).select("s_suppkey", "a.*")


@query("""
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN trim(url) WHEN 1 THEN coalesce(nullif(regexp_extract('see ' || url || ') now', 'https?://[^\\s<>\\])"'']+'), ''), trim('see ' || url || ') now')) ELSE '' END AS found FROM pages WHERE url IS NOT NULL""")
def q_property_url(t):
    """P7."""
    kind = F.element_at(F.array(*map(F.lit, ("url", "rich_text", "number"))), (F.col("page_id") % 3 + 1).cast("int"))
    items = F.array(F.struct(F.lit("see ").alias("plain_text")), F.struct(F.col("url").alias("plain_text")), F.struct(F.lit(") now").alias("plain_text")))
    return t("pages").filter("url is not null").select("page_id", rec.property_url(kind, F.col("url"), items).alias("found"))


@query(f"""
    WITH p AS (SELECT l_orderkey, {PLACE} AS place, 'f' || (l_partkey % 5) AS name, CASE l_suppkey % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'title' ELSE 'number' END AS kind FROM lineitem)
    SELECT l_orderkey, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN name = 'f0' THEN 1 WHEN contains(name, '3') THEN 2 ELSE 3 END, place) AS n FROM p WHERE kind IN ('url', 'title')) WHERE n = 1""")
def q_pick_property(t):
    """P8."""
    kind = F.when(F.col("l_suppkey") % 4 == 0, "url").when(F.col("l_suppkey") % 4 == 1, "title").otherwise("number")
    rows = t("lineitem").select("l_orderkey", F.expr(PLACE).alias("place"), F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("name"), kind.alias("kind"))
    return rec.picked_property(rows, "l_orderkey", "name", "kind", "place", "f0", ["url", "title"], ["3"])


@query("""
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END, -o_orderkey) AS trans_id, o_orderstatus AS status, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 5 = 0 THEN '' || o_custkey END, '') AS name FROM orders""")
def q_simple_record(t):
    """Renamed and coalesced."""
    o = F.col("o_orderkey")
    name = F.coalesce(F.when(o % 2 == 0, F.col("o_orderpriority")), F.when(o % 5 == 0, F.col("o_custkey").cast("string")), F.lit(""))
    return t("orders").select("o_orderkey", F.coalesce(F.when(o % 3 != 0, o), -o).alias("trans_id"), F.col("o_orderstatus").alias("status"), name.alias("name"))


@query("""
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{"title":[{"text":{"content":"' || p_name || '"}}]}' WHEN 1 THEN '{"rich_text":[{"text":{"content":"' || p_name || '"}}]}' END AS title,
        CASE WHEN p_partkey % 5 = 0 THEN CASE p_size % 4 WHEN 0 THEN '{"select":{"name":"已存到本地"}}' WHEN 1 THEN '{"status":{"name":"已存到本地"}}' WHEN 2 THEN '{"checkbox":true}' END
        WHEN p_partkey % 5 >= 3 THEN CASE p_size % 4 WHEN 0 THEN '{"select":{"name":"3次存到本地失败"}}' WHEN 1 THEN '{"status":{"name":"3次存到本地失败"}}' END END AS state FROM part""")
def q_payloads(t):
    """P10."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % n + 1).cast("int"))
    title = rec.title_payload(pick(("title", "rich_text", "url"), 3), F.concat(F.lit("  "), F.col("p_name")))
    return t("part").select("p_partkey", title.alias("title"), rec.state_payload(pick(("select", "status", "checkbox", "number"), 4), F.col("p_partkey") % 5).alias("state"))


@query("""
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '1-a' WHEN 'MACHINERY' THEN '2-b' ELSE '6-其他' END AS folder FROM customer""")
def q_category_folder(t):
    """P13."""
    return t("customer").select("c_custkey", rec.category_folder(F.col("c_mktsegment"), {"BUILDING": "1-a", "MACHINERY": "2-b"}).alias("folder"))


@query("""
    SELECT event_id, '{"step":' || (event_id % 7) || ',"name":"' || event_type || '","status":"' || CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END || '","success":' || CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END
        || ',"elapsed":' || (event_id % 90) || CASE WHEN event_type = 'error' THEN ',"error":"e' || user_id || '"' ELSE '' END || '}' AS line FROM events""")
def q_report_line(t):
    """P14."""
    e, bad = F.col("event_id"), F.col("event_type") == "error"
    error = F.when(bad, F.concat(F.lit("e"), F.col("user_id").cast("string")))
    return t("events").select("event_id", rec.report_json(e % 7, F.col("event_type"), ~bad, e % 90, error).alias("line"))


CHOICES = "CASE o_orderkey % 4 WHEN 0 THEN '1, 3,1,9' WHEN 1 THEN ' all ' WHEN 2 THEN '' || (o_orderkey % 9 - 2) ELSE '全部' END"


@query(f"""
    WITH c AS (SELECT o_orderkey, {CHOICES} AS raw FROM orders), v AS (SELECT *, try_cast(trim(raw) AS BIGINT) AS n FROM c)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'memo,podcast' WHEN trim(raw) = '1' THEN 'memo' WHEN trim(raw) = '2' THEN 'wechat' WHEN trim(raw) = '3' THEN 'podcast' ELSE '' END AS categories,
        coalesce(n > 0, false) OR trim(raw) IN ('all', '全部') AS ok, CASE WHEN n > 0 THEN n END AS most FROM v""")
def q_choices(t):
    """F18 and O11."""
    names = F.create_map(*[F.lit(x) for x in ("1", "memo", "2", "wechat", "3", "podcast")])
    raw = F.expr(CHOICES)
    chosen = F.array_join(F.transform(rec.chosen_of(raw, ["1", "2", "3"]), lambda x: F.element_at(names, x)), ",")
    limit = rec.count_limit(raw)
    return t("orders").select("o_orderkey", chosen.alias("categories"), limit["ok"].alias("ok"), limit["limit"].alias("most"))


@query("""
    SELECT s_suppkey, 'https://h' || s_suppkey || '/v1/chat/completions' AS chat, 'https://example.com/episode/' || s_suppkey AS episode FROM supplier""")
def q_links(t):
    """X12 and X11."""
    key = F.col("s_suppkey").cast("string")
    base = F.concat(F.lit("https://h"), key, F.when(F.col("s_suppkey") % 2 == 0, "/v1/").otherwise("/v1/chat/completions//"))
    return t("supplier").select("s_suppkey", rec.chat_url(base).alias("chat"), F.concat(F.lit("https://example.com/episode/"), key).alias("episode"))


@query("""
    SELECT p_partkey AS num_id, level, coalesce(nullif(format, ''), 'bullet') AS format FROM part JOIN (
        SELECT s_nationkey AS abstract_id, s_suppkey % 3 AS level, arg_max(CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN 'decimal' ELSE 'lowerLetter' END, s_suppkey) AS format FROM supplier GROUP BY ALL) l ON p_size = abstract_id""")
def q_numbering(t):
    """J6."""
    form = F.when(F.col("s_suppkey") % 4 == 0, "").when(F.col("s_suppkey") % 4 == 1, "decimal").otherwise("lowerLetter")
    levels = t("supplier").select(F.col("s_nationkey").alias("abstract_id"), (F.col("s_suppkey") % 3).alias("level"), F.col("s_suppkey").alias("pos"), form.alias("format"))
    return rec.numbering_formats(t("part").select(F.col("p_partkey").alias("num_id"), F.col("p_size").alias("abstract_id")), levels)


@query(f"SELECT l_orderkey, {PLACE} AS place, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY {PLACE}) AS ordinal FROM lineitem")
def q_ordinals(t):
    """W6."""
    rows = t("lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("level"), F.expr(PLACE).alias("place"))
    return rec.ordinals(rows, "l_orderkey", "level", "place").drop("level")


@query(f"SELECT l_orderkey, {PLACE} AS place, coalesce(lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {PLACE}), 0) + l_tax * 100 > 10 AS blank_before FROM lineitem")
def q_block_spacing(t):
    """W12."""
    rows = t("lineitem").select("l_orderkey", F.expr(PLACE).alias("place"), "l_quantity", "l_tax")
    return rec.spaced_blocks(rows, "l_orderkey", "place", F.col("l_tax") * 100, F.col("l_quantity"), 10.0).select("l_orderkey", "place", "blank_before")


@query(f"""
    WITH m AS (SELECT user_id, arg_max(ts, event_id) AS moved_at FROM events WHERE event_type = 'error' GROUP BY user_id), f AS (SELECT user_id, min(ts) AS modified FROM events GROUP BY user_id)
    SELECT f.user_id, coalesce(moved_at, modified) AS since FROM f LEFT JOIN m ON f.user_id = m.user_id WHERE coalesce(moved_at, modified) < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND f.user_id % 3 = 0""")
def q_recycle_purge(t):
    """J9, with U6 and A17's age limit and suffix filter."""
    suffix = F.when(F.col("user_id") % 3 == 0, ".MD").otherwise(".png")
    path = F.concat(F.col("user_id").cast("string"), suffix)
    files = t("events").groupBy("user_id").agg(F.min("ts").alias("modified")).select(path.alias("path"), "modified")
    moves = t("events").filter("event_type = 'error'").select(path.alias("path"), F.col("ts").alias("moved_at"), F.col("event_id").alias("pos"))
    old = rec.expired(rec.ages(files, moves), F.col("since"), F.lit(AS_OF).cast("timestamp_ntz"), 1, [".md"])
    return old.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("user_id"), "since")


@query("""
    WITH h AS (SELECT o_custkey AS k, max(o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), n AS (SELECT o_custkey AS k, min(o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
    SELECT k, seq, false AS added FROM h UNION ALL SELECT k, (SELECT max(seq) FROM h) + 1 + pos, true FROM n WHERE k NOT IN (SELECT k FROM h)""")
def q_mark_processed(t):
    """W16."""
    done = t("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("seq"))
    return rec.prepended(done, t("orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos")), "k", "pos")


@query("SELECT p_brand AS image, min(l_orderkey) AS first_note, count(DISTINCT l_orderkey) AS notes FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.09 GROUP BY p_brand")
def q_delete_plan(t):
    """J14 and A18."""
    refs = t("lineitem").filter("l_discount > 0.09").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("image"), "l_orderkey")
    return rec.image_plan(refs, "image", "l_orderkey")


@query("SELECT c_nationkey, count(*) AS listed, count(o.k) AS moved, count(*) - count(o.k) AS skipped FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o.k GROUP BY c_nationkey")
def q_presence(t):
    """What of the listed exists, counted."""
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rec.presence(t("customer"), urgent, "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("listed"), F.count_if("exists").alias("moved"), F.count_if(~F.col("exists")).alias("skipped"))


@query("SELECT 'nation' AS vault, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 AND n_name = (SELECT max(n_name) FROM nation WHERE n_nationkey % 6 = 0) UNION ALL SELECT 'other', n_name FROM nation WHERE n_nationkey % 3 = 0 AND n_name = (SELECT max(n_name) FROM nation WHERE n_nationkey % 6 = 0)")
def q_name_hits(t):
    """J10."""
    names = t("nation").select("n_nationkey", F.col("n_name").alias("name"))
    wanted = names.filter("n_nationkey % 6 = 0").agg(F.max("name")).first()[0]
    return rec.name_hits({"nation": names.filter("n_nationkey % 2 = 0"), "other": names.filter("n_nationkey % 3 = 0")}, "name", F.lit(wanted))


@query("""
    WITH n AS (SELECT page_id, unnest(string_split(html, '<p')) AS html, generate_subscripts(string_split(html, '<p'), 1) AS pos FROM pages),
    s AS (SELECT page_id, pos, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS shown FROM n)
    SELECT page_id, CAST(arg_min(pos, (-shown, pos)) AS INTEGER) AS pos, CAST(max(shown) AS INTEGER) AS shown FROM s GROUP BY page_id HAVING max(shown) >= 20""".replace("arg_min(pos, (-shown, pos))", "arg_min(pos, row(-shown, pos))"))
def q_richest_node(t):
    """A15."""
    nodes = t("pages").select("page_id", F.posexplode(F.split("html", "<p", -1)).alias("i", "html")).select("page_id", (F.col("i") + 1).alias("pos"), "html")
    return rec.richest(nodes, "page_id", "pos", "html")


@query("SELECT page_id, coalesce(list_max(list_transform(string_split(html, '<tr'), lambda x: len(regexp_extract_all(x, '<t[dh][ >]')))), 0) AS width FROM pages")
def q_table_width(t):
    """The cells of a page's widest table row."""
    widths = F.transform(F.split("html", "<tr", -1), lambda x: F.regexp_count(x, F.lit("<t[dh][ >]")))
    return t("pages").select("page_id", F.coalesce(F.array_max(widths), F.lit(0)).cast("long").alias("width"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS good, count(*) AS done, round(sum(value), 4) AS seconds FROM events GROUP BY user_id")
def q_batch_timings(t):
    """A12."""
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("good"), F.count("*").alias("done"), F.round(F.sum("value"), 4).alias("seconds"))


@query("SELECT source, sum(n) AS items, max(n) AS largest FROM (SELECT source, lang, len(list_distinct(list(doc_id))) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def q_clear_counts(t):
    """Sizes of each key's lists, and their total."""
    lists = t("documents").groupBy("source", "lang").agg(F.countDistinct("doc_id").alias("n"))
    return lists.groupBy("source").agg(F.sum("n").alias("items"), F.max("n").alias("largest"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 3 AS dead FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL HAVING count(*) FILTER (event_type <> 'error') = 0")
def q_dead_letters(t):
    """T8 and T11."""
    tried = t("events").filter("event_type in ('error', 'purchase')").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rec.failure_counts(tried, ["user_id", "day"], F.col("event_type") == "error")


@query("""
    WITH s AS (SELECT o_custkey AS run, o_orderpriority AS step, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'running' END, o_orderkey) AS last FROM orders GROUP BY ALL)
    SELECT run, min(CASE WHEN last <> 'success' THEN step END) AS resume_at FROM s GROUP BY run""")
def q_resume(t):
    """T9."""
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("running")
    steps = t("orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("step"), status.alias("status"), "o_orderkey")
    return rec.resumed(steps, "run", "step", "status", "o_orderkey")


@query("""
    SELECT p_type AS call_type, string_agg(p_name || '#' || p_partkey, ',' ORDER BY p_size, p_name || '#' || p_partkey) AS "order", count(*) AS available FROM part WHERE p_partkey % 5 - 1 > 0 GROUP BY p_type""")
def q_routes(t):
    """U8 and F13."""
    models = t("part").select(F.col("p_type").alias("call_type"), "p_size", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("model"), (F.col("p_partkey") % 5 - 1).alias("left"))
    return rec.routes(models, "call_type", "p_size", F.col("left"))


@query("SELECT * FROM (VALUES ('a.missing', 'missing'), ('key20', 'not positive'), ('key3', 'not a flag')) v(key, problem)")
def q_settings(t):
    """F14."""
    pairs = t("nation").select(F.concat(F.lit("key"), F.col("n_nationkey").cast("string")).alias("key"), F.when(F.col("n_nationkey") == 20, "0").when(F.col("n_nationkey") == 4, "True").otherwise(F.col("n_nationkey").cast("string")).alias("value"))
    return rec.setting_problems(pairs, {"a.missing": "required", "key1": "required", "key20": "positive", "key5": "positive", "key3": "flag", "key4": "flag"})


@query("SELECT lower(n_name) AS sorted_name, row_number() OVER (ORDER BY lower(n_name)) AS n FROM nation")
def q_caseless_order(t):
    """O3: names in order without regard to case; a region's names are few."""
    return t("nation").select(F.lower("n_name").alias("sorted_name")).withColumn("n", F.row_number().over(Window.orderBy("sorted_name")).cast("long"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS title,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || ', ' || o_orderpriority ELSE o_orderpriority || ', x' END AS tags FROM orders""")
def q_metadata_values(t):
    """P1 and P2."""
    o, unknown = F.col("o_orderkey"), F.lit(" 未知 ")
    title = text.first_text(F.when(o % 3 == 0, "  ").otherwise(F.col("o_orderpriority")), F.lit(None).cast("string"), F.col("o_orderstatus"))
    even = F.array(F.concat(F.lit(" "), "o_orderstatus"), unknown, "o_orderpriority", "o_orderstatus")
    odd = F.array(F.lit("无"), "o_orderpriority", F.lit(None).cast("string"), F.lit("x "), "o_orderpriority")
    return t("orders").select("o_orderkey", title.alias("title"), text.joined_distinct(F.when(o % 2 == 0, even).otherwise(odd)).alias("tags"))


@query("SELECT k.key, coalesce(nullif(trim(v.n_name), ''), k.fallback) AS value FROM (VALUES ('key1', 'a'), ('key99', 'b')) k(key, fallback) LEFT JOIN (SELECT 'key' || n_nationkey AS key, n_name FROM nation) v ON k.key = v.key")
def q_settings_defaults(t):
    """S20."""
    pairs = t("nation").select(F.concat(F.lit("key"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return settings(pairs, {"key1": "a", "key99": "b"})

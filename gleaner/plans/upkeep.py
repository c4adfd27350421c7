"""Queries over files and their names: image headers, safe paths, plans of moves, and texts in columns; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import images, layout
from gleaner.operators import moves
from gleaner.plans.catalog import query


def digits(value: Column, n: int, little: bool = False) -> Column:
    """A number as n bytes, in hexadecimal digits."""
    big = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(n))]) if little else big


SIZES_SQL = "(doc_id % 50 * 7 + doc_id % 89 + 1) AS w, (doc_id % 50 * 5 + doc_id % 131 + 1) AS h"


@query(f"""
    SELECT doc_id, kind, CASE WHEN cut THEN NULL ELSE w END AS width, CASE WHEN cut THEN NULL ELSE h END AS height, CASE WHEN cut THEN doc_id % 50 * 200 + 18 >= 5000 ELSE w >= 100 AND h >= 100 END AS ok FROM (
        SELECT *, doc_id % 7 = 6 AS cut, ['png', 'gif', 'jpeg', 'webp', 'webp', 'webp', NULL][CAST(doc_id % 7 AS INT) + 1] AS kind, {SIZES_SQL} FROM documents)""")
def q_image_headers(t):
    """PNG, GIF, JPEG after other segments, the three kinds of WebP, and bytes of no known kind, which are judged by their number."""
    sized = t("documents").selectExpr("doc_id", "CAST(doc_id % 50 AS INT) AS more", *SIZES_SQL.split(", "))
    w, h = F.col("w").cast("long"), F.col("h").cast("long")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), digits(w, 4), digits(h, 4))
    gif = F.concat(F.lit("474946383961"), digits(w, 2, True), digits(h, 2, True), F.lit("0000"))
    other = F.concat(F.lit("FFE1"), digits(F.col("more") + 2, 2), F.repeat(F.lit("FF"), F.col("more")))
    jpeg = F.concat(F.lit("FFD8"), other, F.lit("FFFFDB000400C0FFC2000B08"), digits(h, 2), digits(w, 2), F.lit("01011100FFD9"))
    webp = F.concat(F.lit("524946460000000057454250"))
    extended = F.concat(webp, F.lit("565038580A00000000000000"), digits(w - 1, 3, True), digits(h - 1, 3, True))
    lossless = F.concat(webp, F.lit("5650384C000000002F"), digits((w - 1) + (h - 1) * 16384, 4, True))
    lossy = F.concat(webp, F.lit("5650382000000000000000009D012A"[:22]), F.lit("9D012A"), digits(w, 2, True), digits(h, 2, True))
    unknown = F.repeat(F.lit("00"), F.col("more") * 200 + 18)
    made = F.get(F.array(png, gif, jpeg, extended, lossless, lossy, unknown), (F.col("doc_id") % 7).cast("int"))
    files = sized.select("doc_id", F.unhex(made).alias("content"))
    size = images.image_size(F.col("content"))
    read = files.select("doc_id", images.image_kind(F.col("content")).alias("kind"), size.alias("size"), F.length("content").alias("n"), "content")
    return read.select("doc_id", "kind", "size.width", "size.height", images.image_ok(F.col("content"), F.col("size")).alias("ok"))


RAW = """concat(CASE page_id % 4 WHEN 0 THEN '/vault/' WHEN 1 THEN '/vaults/' WHEN 2 THEN '' ELSE 'a/../../' END, replace(url, '://', '/../'),
    CASE page_id % 5 WHEN 0 THEN '/./x.md' WHEN 1 THEN '/../x.MD' WHEN 2 THEN '/../../../../vault/已读//y.md' WHEN 3 THEN '/.md' ELSE '.txt' END)"""


@query(f"""
    WITH raws AS (SELECT page_id, {RAW} AS raw FROM pages),
    folded AS (SELECT page_id, raw, full_path, list_reduce(list_transform(string_split(full_path, '/'), lambda x: [x]), lambda done, e: CASE WHEN e[1] IN ('', '.') THEN done WHEN e[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[1:len(done) - 1] ELSE done END ELSE list_concat(done, e) END) AS parts
        FROM (SELECT page_id, raw, CASE WHEN raw[1] = '/' THEN raw ELSE '/vault/' || raw END AS full_path FROM raws))
    SELECT page_id, array_to_string(parts, '/') AS path, parts[2] = 'vault' AND (parts[-1] LIKE '%_.md' OR parts[-1] LIKE '%_.MD') AS safe, coalesce(parts[2] = 'vault' AND list_contains(parts[3:len(parts) - 1], '已读') AND (parts[-1] LIKE '%_.md' OR parts[-1] LIKE '%_.MD'), false) AS in_read FROM folded""")
def q_safe_paths(t):
    """paths below a root after their ``..`` are followed; a root's twin by prefix is not the root."""
    paths = t("pages").select("page_id", F.expr(RAW).alias("raw"))
    seen = F.when(F.startswith("raw", F.lit("/")), F.col("raw")).otherwise(F.concat(F.lit("/vault/"), "raw"))
    below = moves.path_below(F.col("raw"), "/vault", ".md")
    return paths.select("page_id", moves.normal_path(seen).alias("path"), below.isNotNull().alias("safe"), moves.in_folder(below, "/vault", [moves.READ]).alias("in_read"))


#: A file's name, which many documents share, and which may look like a numbered one.
NAME = "concat('note', CAST(doc_id % 40 AS {text}), CASE WHEN doc_id % 9 = 0 THEN concat('_', CAST(doc_id % 4 AS {text})) ELSE '' END, '.md')"
AT = "TIMESTAMP '2024-01-20 00:00:00'"


def placed_sql(wanted: str, there: str) -> str:
    """The plan's rule as SQL: who is first by source gets the name, the others the free numbers, listed one by one."""
    return rf"""
    wanted AS ({wanted}), there AS (SELECT DISTINCT path FROM ({there}) WHERE path IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY source) AS n, folder || '/' || name IN (SELECT path FROM there) AS gone FROM wanted),
    plain AS (SELECT source, folder || '/' || name AS destination FROM ranked WHERE n = 1 AND NOT gone),
    later AS (SELECT *, CASE WHEN gone THEN n ELSE n - 1 END AS place FROM ranked WHERE n > 1 OR gone),
    bases AS (SELECT folder, name, max(place) AS most FROM later GROUP BY folder, name),
    blocked AS (SELECT path FROM there UNION SELECT destination FROM plain),
    counts AS (SELECT folder || '/' || regexp_replace(name, '^.*/', '') AS path, count(*) AS c FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(path, '_[1-9][0-9]*\.md$', '.md') AS name FROM blocked WHERE regexp_matches(path, '_[1-9][0-9]*\.md$')) GROUP BY 1),
    numbers AS (SELECT folder, b.name, unnest(range(1, most + coalesce(c, 0) + 1)) AS k FROM bases b LEFT JOIN counts ON path = folder || '/' || b.name),
    free AS (SELECT folder, name, target, row_number() OVER (PARTITION BY folder, name ORDER BY k) AS place FROM (SELECT *, folder || '/' || replace(name, '.md', '_' || k || '.md') AS target FROM numbers) f WHERE NOT EXISTS (SELECT 1 FROM blocked WHERE path = target)),
    plan AS (SELECT source, destination FROM plain UNION ALL SELECT source, target FROM later JOIN free USING (folder, name, place))"""


@query(rf"""
    WITH files AS (SELECT doc_id, '/inbox/' || doc_id || '/' || {NAME.format(text="VARCHAR")} AS source, {NAME.format(text="VARCHAR")} AS name, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 20) AS modified,
        '/bin/' || coalesce(nullif(source, ''), 'unknown') || '/' || coalesce(nullif(lang, ''), 'unknown') || '/20240120' AS folder FROM documents),
    {placed_sql("SELECT source, folder, name FROM files WHERE doc_id % 11 <> 0 OR modified > TIMESTAMP '2024-01-10 00:00:00'", '''
        SELECT folder || '/' || CASE WHEN doc_id % 3 = 0 THEN name ELSE replace(name, '.md', '_' || (1 + doc_id % 7) || '.md') END AS path FROM files JOIN labels USING (doc_id) UNION ALL SELECT '/bin/old/' || doc_id || '.md' FROM files WHERE doc_id % 11 = 0''')}
    SELECT source, destination, {AT} AS moved_at FROM plan""")
def q_recycle_plan(t):
    """Files of documents into the recycle bin, past names that are there; what was moved before and didn't come back stays."""
    folder = F.concat_ws("/", F.lit("/bin"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")), F.lit("20240120"))
    docs = t("documents").select("doc_id", "source", "lang", folder.alias("folder"), F.expr(NAME.format(text="STRING")).alias("name"))
    path = F.concat(F.lit("/inbox/"), F.col("doc_id").cast("string"), F.lit("/"), "name")
    modified = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 20 AS INT))")
    files = docs.select(path.alias("path"), modified.alias("modified"), F.col("source").alias("category"), F.col("lang").alias("item_type"))
    numbered = F.concat(F.regexp_replace("name", r"\.md$", "_"), (1 + F.col("doc_id") % 7).cast("string"), F.lit(".md"))
    there = docs.join(t("labels").select("doc_id"), "doc_id").select(F.concat("folder", F.lit("/"), F.when(F.col("doc_id") % 3 == 0, F.col("name")).otherwise(numbered)).alias("path"))
    done = docs.filter("doc_id % 11 = 0").select(path.alias("source"), F.concat(F.lit("/bin/old/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("destination"), F.expr("TIMESTAMP '2024-01-10 00:00:00'").alias("moved_at"))
    return moves.recycled(files, there, done, "/bin", F.expr(AT))


FLAG = "concat(CASE WHEN doc_id % 3 = 1 THEN '- [x] **是否已读**\n' ELSE '- [ ] **是否已读**\n' END, coalesce(text, ''))"


@query(rf"""
    WITH {placed_sql(f"SELECT '/vault/' || coalesce(source, '') || '/' || doc_id || '/' || coalesce(lang, 'other') || '/' || {NAME.format(text='VARCHAR')} AS source, '/vault/已读/' || CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'rest' END AS folder, {NAME.format(text='VARCHAR')} AS name FROM documents WHERE contains({FLAG}, '- [x] **是否已读**') GROUP BY ALL", "SELECT '/vault/已读/rest/note' || p_partkey || '.md' AS path FROM part WHERE p_size < 20")}
    SELECT source, destination, {AT} AS moved_at FROM plan""")
def q_archive_plan(t):
    """Notes marked as read into the folder of their kind, without two of one name."""
    path = F.concat(F.lit("/vault/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("lang", F.lit("other")), F.lit("/"), F.expr(NAME.format(text="STRING")))
    notes = t("documents").select(path.alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.expr(FLAG).alias("text"))
    there = t("part").filter("p_size < 20").select(F.concat(F.lit("/vault/已读/rest/note"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    done = there.limit(0).select(F.lit("").alias("source"), F.lit("").alias("destination"), F.expr(AT).alias("moved_at"))
    return moves.archived(notes, there, done, "/vault", ["en", "de", "rest"], F.expr(AT))


SHOWN = "translate(concat(coalesce(source, '-'), ' ', coalesce(lang, '-'), ' ', doc_id * 7919, ' note'), 'aeiou', '码文本行宽')"
WIDTH_SQL = "CASE WHEN e[1].c IN ('码', '文', '本', '行', '宽') THEN 2 ELSE 1 END"


@query(rf"""
    WITH shown AS (SELECT doc_id, {SHOWN} AS s FROM documents),
    chars AS (SELECT doc_id, s, list_transform(string_split(s, ''), lambda c: [{{'c': c, 'n': CAST(0 AS INT)}}]) AS cs FROM shown),
    folded AS (SELECT doc_id, s, list_reduce(list_prepend([{{'c': '', 'n': CAST(0 AS INT)}}], cs), lambda done, e: CASE WHEN done[-1].n + {WIDTH_SQL} > 15 THEN list_concat(done, [{{'c': '> ' || e[1].c, 'n': CAST(2 + {WIDTH_SQL} AS INT)}}])
        ELSE list_concat(done[1:len(done) - 1], [{{'c': done[-1].c || e[1].c, 'n': CAST(done[-1].n + {WIDTH_SQL} AS INT)}}]) END) AS lines FROM chars),
    fits AS (SELECT doc_id, list_reduce(list_prepend([{{'c': '', 'n': CAST(0 AS INT)}}], cs), lambda done, e: CASE WHEN done[1].n + {WIDTH_SQL} > 11 THEN [{{'c': done[1].c, 'n': CAST(done[1].n + 100 AS INT)}}] ELSE [{{'c': done[1].c || e[1].c, 'n': CAST(done[1].n + {WIDTH_SQL} AS INT)}}] END) AS cut FROM chars)
    SELECT doc_id, array_to_string(list_transform(lines, lambda x: x.c), chr(10)) AS lines, cut[1].c || '…' || repeat(' ', CAST(11 - cut[1].n % 100 AS INT)) AS fitted FROM folded JOIN fits USING (doc_id)""")
def q_wrapped(t):
    """Mixed wide and narrow text with colour codes, wrapped to 15 columns with a prefix, and fitted into 12; the codes are taken out at last."""
    shown = F.concat(F.lit("\x1b[1;31m"), F.regexp_replace(F.expr(SHOWN), " ", "\x1b[0m "), F.lit("\x1b[0m"))
    plain = lambda c: F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")
    rows = t("documents").select("doc_id", layout.wrapped(shown, 15, "> ").alias("lines"), layout.fitted(shown, 12).alias("fitted"))
    return rows.select("doc_id", plain(F.array_join("lines", "\n")).alias("lines"), plain(F.col("fitted")).alias("fitted"))

"""Operators over records: property values and payloads, accounts, recycling, retries, numbering and clean-up plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import blank_to_null, squeezed

# What a note's row is marked with, and after how many failures.
STORED, FAILED, MOST_FAILURES = "已存到本地", "3次存到本地失败", 3
OTHER_FOLDER = "6-其他"


def account(raw: Column) -> Column:
    """P5: struct<url, name, short_name> of an account that is a URL or a JSON record; the short name falls back to the name."""
    part = lambda n: F.trim(F.coalesce(F.get_json_object(raw, f"$.{n}"), F.lit("")))
    short = F.trim(F.coalesce(F.get_json_object(raw, "$.short_name"), F.get_json_object(raw, "$.name"), F.lit("")))
    record = F.struct(part("url").alias("url"), part("name").alias("name"), short.alias("short_name"))
    plain = F.struct(raw.alias("url"), F.lit("").alias("name"), F.lit("").alias("short_name"))
    return F.when(F.ltrim(raw).startswith("{"), record).otherwise(plain)


def plain_text(items: Column) -> Column:
    """The joined plain_text of a property's items (array of structs)."""
    return F.trim(F.array_join(F.transform(items, lambda x: F.coalesce(x["plain_text"], F.lit(""))), ""))


def property_url(kind: Column, url: Column, items: Column) -> Column:
    """A property's URL: its own, or the first one in its text, or the text; '' for other types."""
    shown = plain_text(items)
    found = F.regexp_extract(shown, r"""(https?://[^\s<>\])"']+)""", 1)
    return F.when(kind == "url", F.trim(F.coalesce(url, F.lit("")))).when(kind.isin("rich_text", "title"), F.coalesce(F.nullif(found, F.lit("")), shown)).otherwise("")


def picked_property(properties: DataFrame, page: str, name: str, kind: str, place: str, preferred: str, allowed: list[str], hints: list[str] = ()) -> DataFrame:
    """Of each page's properties of an allowed type the preferred one, else the first with a hint in its name, else the first."""
    hinted = reduce(lambda a, b: a | b, [F.col(name).contains(h) for h in hints], F.lit(False))
    rank = F.when(F.col(name) == preferred, 1).when(hinted, 2).otherwise(3)
    return properties.filter(F.col(kind).isin(*allowed)).groupBy(page).agg(F.min_by(F.struct(name, kind), F.struct(rank, place)).alias("p")).select(page, f"p.{name}", f"p.{kind}")


def title_payload(kind: Column, title: Column) -> Column:
    """P10: the JSON that writes a title to a title or text property; null where there is nothing to write."""
    shown = squeezed(F.coalesce(title, F.lit("")))
    value = F.array(F.struct(F.struct(shown.alias("content")).alias("text")))
    made = F.when(kind == "title", F.to_json(F.struct(value.alias("title")))).when(kind == "rich_text", F.to_json(F.struct(value.alias("rich_text"))))
    return F.when(shown != "", made)


def state_payload(kind: Column, failures: Column) -> Column:
    """The JSON that marks a row: stored without failures; from the last one on failed; null in between, or where the type can't."""
    name = F.when(failures == 0, STORED).when(failures >= MOST_FAILURES, FAILED)
    named = F.struct(name.alias("name"))
    made = F.when(kind == "select", F.to_json(F.struct(named.alias("select")))).when(kind == "status", F.to_json(F.struct(named.alias("status"))))
    return F.when((kind == "checkbox") & (failures == 0), F.to_json(F.struct(F.lit(True).alias("checkbox")))).when(name.isNotNull(), made)


def failure_counts(events: DataFrame, keys: list[str], is_failure: Column, most: int = MOST_FAILURES) -> DataFrame:
    """Failures of each key that never succeeded, and whether it is given up (dead letter)."""
    counts = events.groupBy(*keys).agg(F.count_if(is_failure).alias("failures"), F.count_if(~is_failure).alias("good"))
    return counts.filter("good = 0").select(*keys, "failures", (F.col("failures") >= most).alias("dead"))


def category_folder(category: Column, folders: dict[str, str]) -> Column:
    """A category's folder, or the one of all others."""
    pairs = F.create_map(*[F.lit(x) for pair in sorted(folders.items()) for x in pair])
    return F.coalesce(F.element_at(pairs, category), F.lit(OTHER_FOLDER))


def report_json(step: Column, name: Column, success: Column, elapsed: Column, error: Column) -> Column:
    """A task's result as a line of a report."""
    status = F.when(success, "success").otherwise("failed")
    return F.to_json(F.struct(step.alias("step"), name.alias("name"), status.alias("status"), success.alias("success"), elapsed.alias("elapsed"), error.alias("error")))


def chosen_of(raw: Column, valid: list[str]) -> Column:
    """the valid items of a comma list, in order, once each."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), ",", -1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x.isin(*valid)))


def count_limit(raw: Column) -> Column:
    """struct<ok, limit> of a wanted number: null limit for all of them; not ok unless a positive integer."""
    shown = F.trim(F.coalesce(raw, F.lit("")))
    number = F.when(F.regexp_like(shown, F.lit(r"^[+-]?[0-9]+$")), shown.try_cast("long"))
    every = F.lower(shown).isin("all", "所有", "全部")
    return F.struct((every | F.coalesce(number > 0, F.lit(False))).alias("ok"), F.when(number > 0, number).alias("limit"))


def chat_url(base: Column) -> Column:
    """The end point below a base URL, unless that names it already."""
    bare = F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", "")
    return F.when(bare.endswith("/chat/completions"), bare).otherwise(F.concat(bare, F.lit("/chat/completions")))


def numbering_formats(numbers: DataFrame, levels: DataFrame) -> DataFrame:
    """(num_id, level, format) by num_id's abstract_id; of repeated levels the last; a blank format is a bullet."""
    last = levels.groupBy("abstract_id", "level").agg(F.max_by("format", "pos").alias("format"))
    return numbers.join(last, "abstract_id").select("num_id", "level", F.coalesce(blank_to_null(F.col("format")), F.lit("bullet")).alias("format"))


def ordinals(items: DataFrame, list_id: str | list[str], level: str, pos: str, where: Column | None = None) -> DataFrame:
    """The running number of an item within its list and level; a document's list is one (bounded) group. where: only such items count,
    others get null."""
    keys = [list_id] if isinstance(list_id, str) else list_id
    order = Window.partitionBy(*keys, level).orderBy(pos)
    if where is None:
        return items.withColumn("ordinal", F.row_number().over(order).cast("long"))
    return items.withColumn("ordinal", F.when(where, F.count_if(where).over(order)))


def spaced_blocks(blocks: DataFrame, doc: str, pos: str, above: Column, below: Column, least: float) -> DataFrame:
    """Blocks before which a blank line goes: the margin below the previous one and above this exceed ``least``."""
    before = F.coalesce(F.lag(below).over(Window.partitionBy(doc).orderBy(pos)), F.lit(0.0))
    return blocks.withColumn("blank_before", before + above > least)


def ages(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files (path, modified) with ``since``: when the manifest's last entry moved them there, else when they were modified."""
    last = moves.filter("moved_at is not null").groupBy("path").agg(F.max_by("moved_at", "pos").alias("moved_at"))
    return files.join(last, "path", "left").select("path", "modified", F.coalesce("moved_at", "modified").alias("since"))


def expired(files: DataFrame, since: Column, as_of: Column, days: int, suffixes: list[str] = ()) -> DataFrame:
    """Files of the given suffixes (all without) older than so many days; none if days are negative."""
    if days < 0:
        return files.limit(0)
    out = files.filter(since < as_of - F.make_dt_interval(days=F.lit(days)))
    return out.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)) if suffixes else out


def prepended(history: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """New keys before the old ones, the last one first; (key, seq, added), seq counting up from old to new, so reading is by seq desc."""
    new = items.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order)).join(history.select(key), key, "left_anti")
    top = history.agg(F.max("seq")).first()[0]
    ranked = new.select(key, (F.lit(-1 if top is None else top) + 1 + F.col(order)).alias("seq"), F.lit(True).alias("added"))
    return history.select(key, "seq", F.lit(False).alias("added")).unionByName(ranked)


def image_plan(references: DataFrame, image: str, note: str) -> DataFrame:
    """Each image once, with the first note that refers to it and the number of notes that do."""
    return references.groupBy(image).agg(F.min(note).alias("first_note"), F.countDistinct(note).alias("notes"))


def presence(listed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The listed rows with ``exists``: whether the key is among the existing ones."""
    return listed.join(existing.select(key).distinct().withColumn("exists", F.lit(True)), key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def name_hits(vaults: dict[str, DataFrame], name: str, wanted: Column) -> DataFrame:
    """Rows with exactly the wanted name in each of several relations, kept apart by ``vault``."""
    parts = [rows.filter(F.col(name) == wanted).select(F.lit(vault).alias("vault"), name) for vault, rows in sorted(vaults.items())]
    return reduce(DataFrame.unionByName, parts)


def richest(nodes: DataFrame, page: str, pos: str, html: str, least: int = 20) -> DataFrame:
    """Each page's node with the most visible characters, the first on ties; pages whose best has under ``least`` go."""
    shown = F.length(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"\s+", " ")))
    best = nodes.withColumn("shown", shown).groupBy(page).agg(F.max(F.struct(F.col("shown"), (-F.col(pos)).alias("back"))).alias("b"))
    return best.filter(F.col("b.shown") >= least).select(page, (-F.col("b.back")).alias(pos), F.col("b.shown").alias("shown"))


def resumed(steps: DataFrame, run: str, step: str, status: str, order: str) -> DataFrame:
    """Where each run goes on: its first step whose last state isn't success (an interrupted one runs again); null if all are done."""
    last = steps.groupBy(run, step).agg(F.max_by(status, order).alias("last"))
    return last.groupBy(run).agg(F.min(F.when(F.col("last") != "success", F.col(step))).alias("resume_at"))


def routes(models: DataFrame, call_type: str, priority: str, remaining: Column) -> DataFrame:
    """Each call type's models in the order they are tried, those with quota left only."""
    order = F.transform(F.array_sort(F.collect_list(F.struct(priority, "model"))), lambda x: x["model"])
    return models.filter(remaining > 0).groupBy(call_type).agg(F.array_join(order, ",").alias("order"), F.count("*").alias("available"))


def setting_problems(settings: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(key, problem) of settings that break their rule: required, positive (an integer) or flag (true or false); missing ones too."""
    wanted = settings.sparkSession.createDataFrame(sorted(rules.items()), "key string, rule string")
    value = F.trim(F.coalesce("value", F.lit("")))
    problem = F.when((F.col("rule") == "required") & (value == ""), "missing").when((F.col("rule") == "positive") & ~F.coalesce(value.try_cast("long") > 0, F.lit(False)), "not positive").when((F.col("rule") == "flag") & ~F.lower(value).isin("true", "false"), "not a flag")
    return F.broadcast(wanted).join(settings, "key", "left").select("key", problem.alias("problem")).filter("problem is not null")

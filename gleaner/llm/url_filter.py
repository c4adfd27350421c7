"""Operator 10 (native): URL filters by rules and by a character language-model ratio.

Rules decide where they fit. All other URLs are judged by two smoothed variable-order Markov models over URL characters, one of the URLs that
rules allow and one of those they block: each character is scored with the longest context (up to three characters) that was seen before it,
probabilities being interpolated with those of shorter contexts. A URL's score is the mean log-likelihood difference of its characters; the
threshold lies equally many standard deviations from both classes' mean scores, on the quarter of the rules' URLs (by a hash of the URL) that
the models haven't seen.

All of it is DataFrame functions. Counts come from all URLs, summed before they are shuffled. Characters are mapped to SYMBOLS symbols, so a
model has at most the sum of SYMBOLS**k entries for k up to ORDER (2.9 million of about 30 bytes), whatever the input. A length of grams is
broadcast if it has up to GRAMS entries, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import checkpointed

#: (action, host and path) rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-case letters, a digit, eleven marks, any other, the start and the end.
SYMBOLS, ORDER = 41, 4
#: Entries of a length of grams that are broadcast (about 40 MB).
GRAMS = 400_000
#: Pull of a shorter context's probability, in characters.
PULL = 4.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. A rule fits its host and all subdomains, if the path starts as its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The URL without its scheme, in symbols, between three starts and an end."""
    plain = F.translate(F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z]+://", "")), "0123456789", "0000000000")
    return F.concat(F.lit("^^^"), F.regexp_replace(plain, r"[^a-z0/._?=&#:%+~-]", "*"), F.lit("$"))


def characters(rows: DataFrame) -> DataFrame:
    """A row for each character of column s, with its gram of ORDER symbols; s goes."""
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.length("s") - (ORDER - 1))).alias("i")).withColumn("gram", F.expr(f"substring(s, i, {ORDER})")).drop("s", "i")


def model(train: DataFrame) -> DataFrame:
    """(gram, ratio) from train (s, accepted): the log ratio of a gram's last symbol after its others, under the two models."""
    side = [F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")]
    full = characters(train.select("s", "accepted")).groupBy("gram").agg(*side)
    grams = [checkpointed(full)]
    for k in range(ORDER - 1, 0, -1):
        grams.append(checkpointed(grams[-1].select(F.expr(f"right(gram, {k})").alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))))
    before = None
    out = []
    for k, g in enumerate(reversed(grams), 1):
        context = g.groupBy(F.expr(f"left(gram, {k - 1})").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        level = g.withColumn("context", F.expr(f"left(gram, {k - 1})")).join(context, "context")
        if before is None:
            level = level.withColumn("pa", F.lit(1.0 / SYMBOLS)).withColumn("pr", F.lit(1.0 / SYMBOLS))
        else:
            level = level.withColumn("lower", F.expr(f"right(gram, {k - 1})")).join(before, "lower")
        level = level.select("gram", ((F.col("a") + PULL * F.col("pa")) / (F.col("ca") + PULL)).alias("pa"), ((F.col("r") + PULL * F.col("pr")) / (F.col("cr") + PULL)).alias("pr"))
        level = checkpointed(level)
        before = level.withColumnRenamed("gram", "lower")
        out.append(level.select("gram", F.ln(F.col("pa") / F.col("pr")).alias("ratio")))
    whole = out[0]
    for level in out[1:]:
        whole = whole.union(level)
    return checkpointed(whole)


def scored(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """rows (s, and others, which stay) with ``score``: the mean ratio of the characters. Summed before the shuffle, a row each."""
    keep = [c for c in rows.columns if c != "s"]
    each = characters(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = []
    entries = {r["k"]: r["n"] for r in grams.groupBy(F.length("gram").alias("k")).agg(F.count("*").alias("n")).collect()}  # ORDER rows
    for k in range(ORDER, 0, -1):
        level = grams.filter(F.length("gram") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        each = each.join(F.broadcast(level) if entries.get(k, 0) <= GRAMS else level, F.expr(f"right(gram, {k})") == F.col(f"g{k}"), "left")
        found.append(F.col(f"r{k}"))
    ratio = F.coalesce(*found, F.lit(0.0))
    return each.groupBy("_row", *keep).agg(F.avg(ratio).alias("score")).drop("_row")


def threshold(train: DataFrame, grams: DataFrame) -> float | None:
    """Where the scores of both classes lie equally many of their deviations away; None if a class is missing."""
    seen = {r["accepted"]: r for r in scored(train, grams).groupBy("accepted").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("sd")).collect()}
    if len(seen) < 2:
        return None
    a, r = seen[True], seen[False]
    if not a["sd"] + r["sd"]:
        return (a["mean"] + r["mean"]) / 2
    return (a["mean"] * r["sd"] + r["mean"] * a["sd"]) / (a["sd"] + r["sd"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row.

    A null url, or one without ``://``, has an empty host and path. Where no rule fits the models decide; if the unseen quarter
    lacks a class the threshold comes from all URLs with a rule, and if these do everything else is allowed. Repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), symbols(url).alias("s"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "s", "rule.rule", "rule.verdict")
    train = ruled.filter("verdict is not null").select("s", (F.col("verdict") == "allow").alias("accepted"))
    unseen = F.pmod(F.xxhash64("s"), F.lit(4)) == 0
    grams = model(train.filter(~unseen))
    cut = threshold(train.filter(unseen), grams)
    if cut is None:
        cut = threshold(train, grams)
    if cut is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    said = F.when(F.col("score") >= cut, "allow").otherwise("block")
    by_method = scored(ruled.filter("verdict is null").select("page_id", "host", "path", "rule", "s"), grams).select("page_id", "host", "path", "rule", said.alias("verdict"))
    return ruled.filter("verdict is not null").select("page_id", "host", "path", "rule", "verdict").unionByName(by_method)

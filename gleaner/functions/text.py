"""Column functions for names, dates, URLs and Markdown. Nothing reads the clock: dates come in as ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any script: what (?U)\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*map(blank_to_null, columns))


def joined_distinct(values: Column, drop=("", "未知", "无")) -> Column:
    """An array's trimmed values, without the dropped ones, in order, once each, joined with ', '."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~x.isin(*drop))), ", ")


def item_key(title: Column, primary: Column, fallback: Column) -> Column:
    """Trimmed title, a bar, and the first 10 characters of the first date that isn't blank."""
    return F.concat(F.trim(title), F.lit("|"), F.substring(F.coalesce(first_text(primary, fallback), F.lit("")), 1, 10))


def key_date(key: Column) -> Column:
    """What follows the last bar, trimmed."""
    return F.when(key.contains("|"), F.trim(F.substring_index(key, "|", -1))).otherwise("")


def title_without_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.(mp3|m4a|wav|mp4|mov)$", "")


def file_name(c: Column) -> Column:
    """Characters that file systems refuse become '_'; at most 100; 'untitled' if nothing is left."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*]', "_")), r"\.+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, 100), F.lit("")), F.lit("untitled"))


def tight_name(c: Column, most: int = 90) -> Column:
    """As file_name(), also control characters, white space collapsed, no space or dot at the end."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " ")
    return F.regexp_replace(F.substring(F.trim(clean), 1, most), r"[ .]+$", "")


def spaced_name(c: Column, default: str) -> Column:
    """Refused characters become spaces, collapsed; at most 120."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*]', " "), r"\s+", " ")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.trim(clean), r"[. ]+$", ""), 1, 120), F.lit("")), F.lit(default))


def removed_name(c: Column) -> Column:
    """Refused characters go, a star stays."""
    return F.regexp_replace(c, r'[\\/:?"<>|]', "")


def squeezed(c: Column, most: int = 200) -> Column:
    """White space collapsed, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def urls_in(c: Column) -> Column:
    """All URLs of a text, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1)))


def fixed_chunks(c: Column, size: int) -> Column:
    """W10's hard cut: slices of a fixed number of characters."""
    n = F.greatest(F.ceil(F.length(c) / size), F.lit(0)).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def seconds_text(s: Column) -> Column:
    """H:mm:ss or m:ss; 未知 for nothing."""
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(s.isNull() | (s <= 0), "未知").when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def elapsed_text(s: Column) -> Column:
    """12.3s, or 2m05s from a minute on."""
    whole = F.floor(s).cast("int")
    return F.when(s < 60, F.concat((F.floor(s * 10 + 0.5) / 10).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s")))


def back_off(base: Column, attempt: Column, cap: float) -> Column:
    """Base doubled with each attempt, capped, to a tenth."""
    return F.round(F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(cap)), 1)


def monday(d: Column) -> Column:
    """The Monday of a date's ISO week."""
    return F.date_trunc("week", d).cast("date")


def compact_date(text: Column, as_of: str) -> Column:
    """The first 19 characters in one of four forms as yyyyMMdd, else as_of."""
    t = F.substring(text, 1, 19)
    found = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")])
    return F.coalesce(F.date_format(found, "yyyyMMdd"), F.lit(as_of.replace("-", "")))


def without_thinking(c: Column) -> Column:
    """<think> blocks go, then <thinking> ones, then white space at both ends."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<thinking>.*?</thinking>", ""))


#: Phrases by which a model's answer is a refusal, matched without regard to case.
REFUSALS = ("无法处理", "无法回答", "没有提供", "未提供文本", "作为一个AI", "as an ai")


def answer_ok(c: Column, least: int = 20) -> Column:
    """struct<ok, reason> of a model's answer, with the reasons that reports show."""
    answer = without_thinking(F.coalesce(c, F.lit("")))
    said = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), reason.alias("reason"))
    out = said(True, F.lit(""))
    for phrase in reversed(REFUSALS):
        out = F.when(F.lower(answer).contains(phrase.lower()), said(False, F.lit(f"AI 响应疑似失败话术: {phrase}"))).otherwise(out)
    short = F.concat(F.lit("AI 响应过短（"), F.length(answer).cast("string"), F.lit(" 字符）"))
    return F.when(F.length(answer) < least, said(False, short)).otherwise(out)


def quality(c: Column, least: int, refusals=REFUSALS) -> Column:
    """struct<ok, reason> of an answer: long enough without thinking, and no refusal."""
    text = without_thinking(F.coalesce(c, F.lit("")))
    refused = F.lit(False)
    for phrase in refusals:
        refused = refused | F.lower(text).contains(phrase)
    return F.when(F.length(text) < least, F.struct(F.lit(False).alias("ok"), F.lit("too_short").alias("reason"))).when(refused, F.struct(F.lit(False).alias("ok"), F.lit("refusal").alias("reason"))).otherwise(F.struct(F.lit(True).alias("ok"), F.lit("").alias("reason")))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule, in declared order, whose text occurs (lower case)."""
    out = F.lit(default)
    for part, name in reversed(rules):
        out = F.when(F.lower(text).contains(part), name).otherwise(out)
    return out


def table_cell(c: Column) -> Column:
    """Bars escaped, line breaks as <br>."""
    return F.regexp_replace(F.replace(F.trim(c), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")


def demoted_headings(c: Column) -> Column:
    """If there is an H1, each heading sinks a level; H6 stays. Lines end at a line feed only."""
    return F.when(F.regexp_like(c, F.lit(r"(?md)^#\s")), F.regexp_replace(c, r"(?md)^(#{1,5})(\s)", "#$1$2")).otherwise(c)


def squeezed_lines(c: Column, blank: int) -> Column:
    """No space at line ends, at most so many blank lines, trimmed."""
    clean = F.regexp_replace(c, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(clean, r"\n{%d,}" % (blank + 2), "\n" * (blank + 1)), r"^\s+|\s+$", "")


def section(c: Column, heading: str) -> Column:
    """The text below a level-one heading, up to the next one; null without it (Q17: at a line's start)."""
    return F.nullif(F.regexp_extract(c, r"(?ms)^# " + heading + r"[ \t]*\n(.*?)(?=^# |\z)", 1), F.lit(""))


def front_matter(c: Column, name: str) -> Column:
    """The value of a bullet line `- **name**: value`."""
    return blank_to_null(F.regexp_extract(c, r"(?m)^- \*\*" + name + r"\*\*[:：][ \t]*(.*)$", 1))


def is_read(c: Column) -> Column:
    """the read flag is ticked."""
    return c.contains("- [x] **是否已读**")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 0 to 255 channels (Q8: the weights that sum to 1)."""
    lin = lambda x: F.when(x / 255 <= 0.03928, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def url_part(url: Column, part: str) -> Column:
    """scheme, host, path, query or fragment by the generic URI pattern; '' if absent."""
    group = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)#?(.*)$", group)


def page_title(html: Column) -> Column:
    """The title of a page, else its first heading; tags and the common entities resolved."""
    raw = first_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    text = F.regexp_replace(raw, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeezed(text)

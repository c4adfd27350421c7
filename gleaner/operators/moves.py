"""Moves of files as plans: paths that stay below a root, destinations free of collision, manifests that can be replayed.

Nothing is moved here. A plan is a table of (source, destination), which whoever owns the store carries out; its rows, appended to the
manifest, keep the next plan from moving the same files again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.notes import safe_part
from gleaner.functions.text import is_read
from gleaner.operators.incremental import running_sum
from gleaner.sources.readers import kept

#: Folders of read notes. Fixed value.
READ = "已读"
OTHER = "其他"


def normal_path(path: Column) -> Column:
    """a path without empty parts, ``.`` and ``..``, by its letters alone. A relative one keeps the ``..`` that lead out of it."""
    absolute = F.startswith(path, F.lit("/"))

    def step(stack: Column, part: Column) -> Column:
        back = F.when((F.size(stack) > 0) & (F.coalesce(F.element_at(stack, -1), F.lit("")) != ".."), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        back = back.when(absolute, stack).otherwise(F.concat(stack, F.array(part)))
        return F.when(part.isin("", "."), stack).when(part == "..", back).otherwise(F.concat(stack, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def path_below(path: Column, root: str, suffix: str | None = None, absolute: bool = True) -> Column:
    """the normal form of a path that is the root or below it, a relative one seen from the root; null for all others.

    suffix: what its name must end with, in any case, after at least one character; absolute=False refuses absolute paths. Null and empty
    paths are null.
    """
    top = root.rstrip("/")
    full = normal_path(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(f"{top}/"), path)))
    ok = (path != "") & ((full == (top or "/")) | F.startswith(full, F.lit(f"{top}/")))
    if suffix:
        ok = ok & F.endswith(F.lower(full), F.lit(suffix.lower())) & ~F.endswith(F.lower(full), F.lit(f"/{suffix.lower()}"))
    if not absolute:
        ok = ok & ~F.startswith(path, F.lit("/"))
    return F.when(ok, full)


def in_folder(path: Column, root: str, names: list[str]) -> Column:
    """whether a path_below() lies in a folder of one of the names, at any depth below the root."""
    inner = F.split(F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)), "/", -1)
    return F.coalesce(F.arrays_overlap(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0))), F.array(*map(F.lit, names))), F.lit(False))


def halves(name: Column) -> tuple[Column, Column]:
    """A file name's stem and suffix; a dot at its beginning or end begins no suffix, not even with a number behind (``a._1``)."""
    suffix = F.regexp_extract(name, r"(?s)^.+(\.(?!_[1-9][0-9]*$)[^.]+)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix)), suffix


def numbered_names(names: DataFrame) -> DataFrame:
    """(folder, name, k): of names (folder, name) that end in _k, the name that they are a number of, and k."""
    stem, suffix = halves(F.col("name"))
    parts = names.select("folder", suffix.alias("suffix"), F.regexp_extract(stem, r"(?s)^(.+)_[1-9][0-9]*$", 1).alias("base"), F.regexp_extract(stem, r"_([1-9][0-9]*)$", 1).try_cast("long").alias("k"))
    return parts.filter("base <> '' and k is not null").select("folder", F.concat("base", "suffix").alias("name"), "k")


def free_names_for(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, folder, free) for wanted (source, folder, name): names that neither exist nor are given twice.

    Of those who want a name, the first by source gets it, unless it exists; the others get name_1, name_2 and so on, in order, past all numbers
    that exist or that somebody wanted and got. Ranks and offsets are running sums, so no name is one task.
    """
    existing = existing.select("folder", "name").distinct()
    ranked = running_sum(wanted.select("source", "folder", "name"), ["folder", "name"], [F.col("source")], F.lit(1).cast("long"), "rank")
    judged = kept(ranked.join(existing.withColumn("there", F.lit(1)), ["folder", "name"], "left"))
    plain = judged.filter("rank = 1 and there is null")
    # Who didn't get a name: places 1, 2, ... among the numbers that are free.
    later = judged.filter("rank > 1 or there is not null").withColumn("place", F.col("rank") - F.when(F.col("there").isNull(), 1).otherwise(0))
    taken = numbered_names(existing.unionByName(plain.select("folder", "name"))).join(later.select("folder", "name").distinct(), ["folder", "name"], "left_semi")
    counted = running_sum(taken, ["folder", "name"], [F.col("k")], F.lit(1).cast("long"), "i")
    # Before the taken number k, the i-th one, k - i numbers are free: a place of more than that lies behind it.
    events = later.select("folder", "name", "source", "place", F.lit(0).cast("long").alias("weight")).unionByName(
        counted.select("folder", "name", F.lit(None).cast("string").alias("source"), (F.col("k") - F.col("i")).alias("place"), F.lit(1).cast("long").alias("weight")).groupBy("folder", "name", "source", "place").agg(F.sum("weight").alias("weight"))
    )
    moved = running_sum(events, ["folder", "name"], [F.col("place"), F.col("source").desc_nulls_last()], F.col("weight"), "behind").filter("source is not null")
    stem, suffix = halves(F.col("name"))
    number = (F.col("place") + F.col("behind")).cast("string")
    return plain.select("source", "folder", F.col("name").alias("free")).unionByName(moved.select("source", "folder", F.concat(stem, F.lit("_"), number, suffix).alias("free")))


def file_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def planned(wanted: DataFrame, existing: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """(source, destination, moved_at): a plan for wanted (source, modified, folder): each source once, into its folder.

    existing: (path) of what is there. done: the manifest (source, destination, moved_at), whose destinations are there too; a source that it moved
    stays where it is unless a newer file has come in its place, so a plan that was carried out plans nothing. Null sources and folders are left
    out; of rows with one source, the newest, then the smallest folder counts.
    """
    once = wanted.filter("source is not null and folder is not null").groupBy("source").agg(F.max("modified").alias("modified"), F.min_by("folder", F.struct(-F.unix_micros("modified"), "folder")).alias("folder"))
    last = done.filter("source is not null").groupBy("source").agg(F.max("moved_at").alias("last"))
    pending = once.join(last, "source", "left").filter("last is null or modified > last").select("source", "folder", file_of(F.col("source")).alias("name"))
    there = existing.select("path").unionByName(done.select(F.col("destination").alias("path"))).filter("path is not null")
    listed = there.select(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1).alias("folder"), file_of(F.col("path")).alias("name"))
    free = free_names_for(pending, listed)
    return free.select("source", F.concat("folder", F.lit("/"), "free").alias("destination"), as_of.alias("moved_at"))


def recycled(files: DataFrame, existing: DataFrame, done: DataFrame, root: str, as_of: Column) -> DataFrame:
    """K9: a plan that puts files (path, modified, category, item_type) into root/category/item_type/day; dots alone can't lead out of root."""
    parts = [F.regexp_replace(safe_part(F.col(c)), r"^\.{1,2}$", "_") for c in ("category", "item_type")]
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), *parts, F.date_format(as_of, "yyyyMMdd"))
    return planned(files.select(F.col("path").alias("source"), F.coalesce("modified", F.lit(0).cast("timestamp")).alias("modified"), folder.alias("folder")), existing, done, as_of)


def archived(notes: DataFrame, existing: DataFrame, done: DataFrame, base: str, folders: list[str], as_of: Column) -> DataFrame:
    """A plan that puts notes (path, modified, text) marked as read into base/已读/folder: that of the note, or the last one if it isn't listed."""
    own = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    folder = F.concat(F.lit(f"{base.rstrip('/')}/{READ}/"), F.when(own.isin(*folders), own).otherwise(folders[-1] if folders else OTHER))
    read = notes.filter(F.endswith("path", F.lit(".md")) & is_read(F.col("text")))
    return planned(read.select(F.col("path").alias("source"), F.coalesce("modified", F.lit(0).cast("timestamp")).alias("modified"), folder.alias("folder")), existing, done, as_of)

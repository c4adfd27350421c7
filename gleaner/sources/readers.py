"""Sources and sinks: tables, notes, JSON records, configuration and idempotent state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, folder: str, exclude: str | None = None) -> DataFrame:
    """Markdown files below a folder (path, text, modified), without those below ``exclude``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))
    return rows.filter(~F.col("path").contains(f"/{exclude}/")) if exclude else rows


def decoded(content: Column) -> Column:
    """Bytes as text by the first encoding of the cascade that fits, else as UTF-8 with replacements."""

    @F.arrow_udf("string")
    def text(blobs: pa.Array) -> pa.Array:
        def one(b: bytes) -> str:
            for name in ("utf-8-sig", "gb18030", "big5"):
                try:
                    return b.decode(name)
                except UnicodeDecodeError:
                    continue
            return b.decode("utf-8", "replace")

        return pa.array([one(b.as_py()) if b.is_valid else None for b in blobs], pa.string())

    return text(content)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed pages of an API, one record a line; the schema is given, bad lines become nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def settings(pairs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Dotted keys with defaults where they are missing or blank."""
    base = pairs.sparkSession.createDataFrame(sorted(wanted.items()), "key string, fallback string")
    return base.join(pairs, "key", "left").select("key", F.coalesce(F.nullif(F.trim("value"), F.lit("")), "fallback").alias("value"))


def free_names(*frames: DataFrame) -> Callable[[str], str]:
    """Names for helper columns that no column of the frames has: a prefix that none of them begins with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for f in frames for c in f.columns):
        prefix += "_"
    return lambda name: prefix + name


def merge_state(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old state with new rows upserted: of each key the row with the greatest ``order``, the new one on ties."""
    is_new, v = map(free_names(old, new), ("new", "v"))
    both = old.withColumn(is_new, F.lit(0)).unionByName(new.withColumn(is_new, F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys and c != is_new]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, is_new)).alias(v)).select(*keys, f"{v}.*")


#: The file that says that a version is complete: how many files it has, and their bytes.
MARKER = "_COMPLETE"


def store(spark: SparkSession, path: str) -> tuple:
    """The file system that has a path, and the path, as the cluster's own objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def contents(spark: SparkSession, folder: str) -> str:
    """How many data files a folder has, and their bytes."""
    fs, path = store(spark, folder)
    sizes = [f.getLen() for f in fs.listStatus(path) if not f.getPath().getName().startswith(("_", "."))]
    return f"{len(sizes)} {sum(sizes)}"


def write_versioned(df: DataFrame, path: str, version: int) -> str:
    """K1: a new version beside the last one, then its marker; a version that is written anew loses its marker first."""
    target, spark = f"{path}/v={version:08d}", df.sparkSession
    df.write.mode("overwrite").parquet(target)
    fs, marker = store(spark, f"{target}/{MARKER}")
    out = fs.create(marker, True)
    out.writeBytes(contents(spark, target))
    out.close()
    return target


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a version has its marker, and all the files and bytes that it names."""
    fs, marker = store(spark, f"{folder}/{MARKER}")
    if not fs.exists(marker):
        return False
    stream = fs.open(marker)
    said = bytes(stream.readAllBytes()).decode("ascii", "replace")
    stream.close()
    return said == contents(spark, folder)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A version that must be complete."""
    folder = f"{path}/v={version:08d}"
    if not is_complete(spark, folder):
        raise ValueError(f"{folder} is not complete")
    return spark.read.parquet(folder)


def latest_version(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """The newest complete version; torn ones are passed over. Without any: the default, or an error."""
    fs, folder = store(spark, path)
    found = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
    for name in found:
        if name.startswith("v=") and is_complete(spark, f"{path}/{name}"):
            return spark.read.parquet(f"{path}/{name}")
    if default is None:
        raise FileNotFoundError(f"no complete version in {path}")
    return default


def drop_version(spark: SparkSession, path: str, version: int) -> None:
    """K1: an old version goes, in whatever store the path names."""
    fs, target = store(spark, f"{path}/v={version:08d}")
    fs.delete(target, True)


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, or, on a local master without it, a temporary one.

    It is deleted when the driver ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{named}/gleaner-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="gleaner-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a work_folder(): computed once where several joins read it, and read again after an executor is lost."""
    path = f"{work_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets this session hand Python workers fewer rows at a time, which bounds what both sides hold of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)) or rows)))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Reports and logs as lines of JSON."""
    df.write.mode("append").json(path)

"""What the operators of this subpackage share: reading a table, and cutting lineage in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.readers import small_batches  # noqa: F401 (for the operators)

#: White space of the word contracts, as a Java regex class body and as what ``bytes.split()`` takes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` is what the cluster names; only a local master, which has one machine, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="gleaner-")
        shared_dir.local = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the JVM has them."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Folders that scratch() has opened, the innermost last.
SCRATCH: list[str] = []


def folder(spark: SparkSession, outside: bool = False) -> str:
    """Where written() puts its tables: the innermost scratch() folder, else one of the application, deleted when its driver ends."""
    if SCRATCH and not outside:
        return SCRATCH[-1]
    own = f"{shared_dir(spark)}/gleaner-{spark.sparkContext.applicationId}"
    path, files = hadoop_path(spark, own)
    files.deleteOnExit(path)
    return own


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written() inside is deleted at the end, but for what is written(outside=True)."""
    SCRATCH.append(f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path, files = hadoop_path(spark, SCRATCH.pop())
        files.delete(path, True)


def written(df: DataFrame, outside: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and read again after an executor is lost. outside: not in scratch()."""
    spark = df.sparkSession
    path = f"{folder(spark, outside)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """As written(), for small tables of iterations: Spark removes the files when the frame is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys of up to so many rows are broadcast (some 20 MB); longer tables of keys are shuffled.
FEW = 200_000


def chosen(rows: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    """rows joined (``how``: left_semi or left_anti) with keys, a written table, without moving the rows where the keys are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, how)


def keeping(rows: DataFrame, keys: DataFrame, on) -> DataFrame:
    return chosen(rows, keys, on, "left_semi")


def dropping(rows: DataFrame, keys: DataFrame, on) -> DataFrame:
    return chosen(rows, keys, on, "left_anti")


def sha_longs(hex_column) -> list:
    """A SHA-256 in hex as four longs, which hash aggregates can hold; sha_text() goes back."""
    return [F.conv(F.substring(hex_column, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]


def sha_text(parts: list):
    return F.concat(*[F.lower(F.lpad(F.hex(p), 16, "0")) for p in parts])

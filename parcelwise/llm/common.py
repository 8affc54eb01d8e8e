"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import scratch_path, stored

__all__ = ["WORD", "SPACES", "column", "fresh_folder", "open_folder", "prepare", "read_table", "prefix_sums", "remove", "slices", "stored"]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch carries to a Python worker; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str):
    """The named column as ``kind``; other columns of the table, whatever their names, are left out by the caller's select."""
    return df[f"`{name}`"].cast(kind)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder nobody has used, in the folder all executors share."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a shared folder; works for every scheme Arrow knows."""
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    system, path = arrow_fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def remove(df: DataFrame) -> None:
    """Delete the files of a stage table nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def slices(items: list, sizes: list[int], most: int) -> Iterator[list]:
    """Cut a list into runs whose sizes add up to at most ``most`` (one item at least)."""
    run, held = [], 0
    for item, size in zip(items, sizes):
        if run and held + size > most:
            yield run
            run, held = [], 0
        run.append(item)
        held += size
    if run:
        yield run


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all smaller buckets of the same keys, one row per (keys, bucket).

    The base of two-level running sums: a window only ever sorts one row per bucket of a key, so a
    key that holds a third of all rows costs no more than any other.
    """
    from pyspark.sql import Window

    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name))

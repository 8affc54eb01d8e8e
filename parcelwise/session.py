"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on.  All are runtime SQL settings,
# so they can be applied to a session the cluster has already created.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Korean price files come as cp949; its Java charset is not in Spark's default list.
    "spark.sql.legacy.javaCharsets": "true",
    # Bytes that do not fit an encoding are replaced and counted, as the CSV reader does, not an error.
    "spark.sql.legacy.codingErrorAction": "true",
}


#: Removes the files of a statement's shuffles as it ends; without it they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Largest side of a join that is broadcast, by the size Spark plans with, and by the size a finished shuffle has.
PLANNED_THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
MEASURED_THRESHOLD = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "parcelwise", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session; ``master`` is only given for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a temporary folder; on a cluster that folder would be a
    different one for each executor, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parcelwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table a job writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the statements run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, name: str, measured: bool = False) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    For results several later branches read: they are computed once, and a lost executor costs a
    re-read instead of the whole lineage.  Nothing reads the shuffles behind it again, so their files go with the write.

    ``measured``: a side of a join is broadcast only once its size has been measured.  Before that Spark sizes rows that are exploded,
    or read from well compressed files, far too low, and the driver would have to hold them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    values = {SHUFFLE_CLEANUP: "true"}
    if measured:
        values |= {MEASURED_THRESHOLD: spark.conf.get(MEASURED_THRESHOLD, None) or spark.conf.get(PLANNED_THRESHOLD), PLANNED_THRESHOLD: "-1"}
    with _set(spark, values):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Partitioned outputs.

A district may hold a third of all rows, so payloads are written row by row, range-split and sorted
inside a district, never as one array per district.  Each district is a directory a reader prunes to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guarantee import BIN_MAX, BIN_SIZE, POLICY
from ..operators.areas import sido_list
from ..operators.officetel import KEY, latest_per_key


def write_district_items(items: DataFrame, path: str, *order: str) -> None:
    """Rows per district in the given order; large districts spread over several sorted files."""
    # The hash splits rows that agree in the order.
    ranged = items.repartitionByRange(F.col("code"), *[F.col(c) for c in order], F.xxhash64(*items.columns))
    ranged.sortWithinPartitions("code", *order).write.mode("overwrite").partitionBy("code").json(path)


def read_district(spark: SparkSession, path: str, code: str, schema: str) -> DataFrame:
    """One district read back; the filter prunes to its directory."""
    return spark.read.schema(f"{schema}, code string").json(path).where(F.col("code") == code)


def write_area_payload(areas: DataFrame, index: DataFrame, path: str, price_year: int) -> None:
    """Neighbourhood rows per district, largest first, the district index with its parameters, and the province list.

    ``index`` is read twice.
    """
    ordered = areas.withColumn("_rank", -F.col("count"))
    ordered.repartitionByRange("code", "_rank", "dong").sortWithinPartitions("code", "_rank", "dong").drop("_rank").write.mode(
        "overwrite"
    ).partitionBy("code").json(f"{path}/areas")
    described = index.withColumns(
        {
            "price_year": F.lit(price_year), "bin_size": F.lit(BIN_SIZE), "bin_max": F.lit(BIN_MAX),
            "types": F.array(*[F.lit(t) for t in POLICY.targets]),
        }
    )
    write_index(described, f"{path}/index")
    sido_list(index).orderBy("sido").coalesce(1).write.mode("overwrite").json(f"{path}/sido")


def write_index(index: DataFrame, path: str) -> None:
    """Small index in one file, by code."""
    index.orderBy("code").coalesce(1).write.mode("overwrite").json(path)


def upsert_officetel(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Merge a yearly load into the stored table; only the years it touches are rewritten.

    The new version of a partition is written beside the table first, because a job must not
    overwrite the files it reads.
    """
    years = [r["year"] for r in fresh.select("year").distinct().collect()]
    try:
        old = spark.read.parquet(path).where(F.col("year").isin(years))
        loads = old.select(*fresh.columns).withColumn("load_seq", F.lit(1)).unionByName(fresh.withColumn("load_seq", F.lit(2)))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        loads = fresh.withColumn("load_seq", F.lit(1))
    merged = latest_per_key(loads)
    staging = f"{path.rstrip('/')}_staging-{uuid.uuid4().hex}"
    merged.write.mode("overwrite").parquet(staging)
    stage = spark.read.schema(merged.schema).parquet(staging)
    stage.repartitionByRange("year", "pnu", "dong", "ho").sortWithinPartitions("year", "pnu", "ho").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("year").parquet(path)

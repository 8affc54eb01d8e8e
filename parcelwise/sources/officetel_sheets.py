"""Yearly office-unit file: exported sheets with positional columns to the keyed table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K

# Fixed values of the file layout: position -> meaning of the 15 columns.
LAYOUT = (
    "unit_no", "kind", "notice_date", "ldcode", "special_lot", "main_lot", "sub_lot", "block",
    "dong", "floor_kind", "floor", "ho", "price", "prvuse", "share",
)
KIND = "오피스텔"


class Load(NamedTuple):
    """Loaded rows and the one-row count of loaded and skipped rows."""

    rows: DataFrame
    accounting: DataFrame


def union_sheets(sheets: Sequence[DataFrame]) -> DataFrame:
    """All sheets under one set of names; columns are taken by position, header rows removed."""
    named = [sheet.select(*[F.col(c).alias(name) for c, name in zip(sheet.columns, LAYOUT)]) for sheet in sheets]
    return reduce(DataFrame.unionByName, named)


def ingest(sheets: Sequence[DataFrame], year: str, prefixes: Sequence[str] | None = None) -> Load:
    """Office rows of all sheets with their parcel key; rows without a valid key are skipped.

    ``prefixes`` keeps legal-dong codes that start with any of them.  Missing labels become ''.
    """
    rows = union_sheets(sheets).where(F.col("kind") == KIND)
    if prefixes:
        code = F.col("ldcode")
        rows = rows.where(reduce(Column.__or__, [code.startswith(p) for p in prefixes]))
    mountain = F.when(F.coalesce(F.col("special_lot"), F.lit("")).contains("산"), "1").otherwise("0")
    keyed = rows.withColumn("pnu", K.build_pnu(F.col("ldcode"), F.col("main_lot"), F.col("sub_lot"), mountain, "juso"))
    label = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    loaded = keyed.where(F.col("pnu").isNotNull()).select(
        "pnu", "ldcode", label("block").alias("building"), label("dong").alias("dong"), label("floor").alias("floor"), label("ho").alias("ho"),
        F.col("prvuse").try_cast("double").alias("prvuse"), F.col("share").try_cast("double").alias("share"),
        F.col("price").try_cast("bigint").alias("price"), F.lit(str(year)).alias("year"),
    )
    accounting = keyed.agg(F.count("pnu").alias("loaded"), F.count_if(F.col("pnu").isNull()).alias("skipped"))
    return Load(loaded, accounting)


def sheets_from_lines(lines: DataFrame) -> list[DataFrame]:
    """Two sheets in the file layout derived from order lines (for the registered queries)."""
    text = lambda c: c.cast("string")
    rows = lines.select(
        text(F.col("l_orderkey")).alias("c0"),
        F.when(F.col("l_linenumber") % 4 == 0, "상가").otherwise(KIND).alias("c1"),
        F.lit("20260101").alias("c2"),
        text(F.col("l_suppkey") + 1100000000).alias("c3"),
        F.when(F.col("l_returnflag") == "A", "산").otherwise("일반").alias("c4"),
        F.when(F.col("l_orderkey") % 17 == 0, "x1").otherwise(text(F.col("l_partkey") % 100)).alias("c5"),
        text(F.col("l_linenumber")).alias("c6"),
        F.lit("tower").alias("c7"),
        F.when(F.col("l_linenumber") != 3, "1").alias("c8"),
        F.lit("지상").alias("c9"),
        text(F.col("l_orderkey") % 9 + 1).alias("c10"),
        text((F.col("l_orderkey") % 9 + 1) * 100 + F.col("l_orderkey") % 4).alias("c11"),
        text(F.floor(F.col("l_extendedprice") * 20)).alias("c12"),
        text(F.col("l_quantity")).alias("c13"),
        F.when(F.col("l_linenumber") != 3, text(F.col("l_quantity") / 2)).alias("c14"),
    )
    first = rows.where(F.col("c4") == "산")
    second = rows.where(F.col("c4") != "산")
    return [first, second.toDF(*[f"s{i}" for i in range(15)])]

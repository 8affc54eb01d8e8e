"""Low-price listing: classification of price rows, browse filters, orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .order_stats import count_values, pick_ranks

DEFAULT_LIMIT = 100_000_000

# Fixed values of the browse screen: label -> [low, high) in square metres.
AREA_BANDS = {"all": (0, 9999), "small": (0, 40), "middle": (40, 60), "large": (60, 9999)}

PRICE_PERM2_SLICE = 10_000.0


def typed_rows(raw: DataFrame) -> DataFrame:
    """Text rows with parsed price, area and district code added."""
    return raw.select(
        "*",
        N.parse_price_signed(F.col("price")).alias("price_won"),
        N.parse_area(F.col("area")).alias("area_m2"),
        N.district_code(F.col("ldcode"), strict=False).alias("code"),
    )


def _short_row(raw: DataFrame) -> Column:
    return F.coalesce(F.col("_short"), F.lit(False)) if "_short" in raw.columns else F.lit(False)


def classify_rows(raw: DataFrame, limit: int = DEFAULT_LIMIT, regions: Sequence[str] | None = None) -> DataFrame:
    """Typed price rows plus ``outcome``: kept, skipped, over_limit or other_region.

    Rows over the cap or outside the wanted districts count neither as kept nor as skipped.  The cap
    is inclusive and is tested before the district.  A short row (``_short`` true) is skipped.
    """
    price_over = F.col("price_won") > limit
    readable = ~_short_row(raw) & price_over.isNotNull() & F.coalesce(F.col("area_m2") > 0, F.lit(False))
    outcome = F.when(~readable, "skipped").when(price_over, "over_limit").when(F.col("code").isNull(), "skipped")
    if regions:
        outcome = outcome.when(~F.col("code").isin(*regions), "other_region")
    return typed_rows(raw).withColumn("outcome", outcome.otherwise("kept"))


def kept_rows(raw: DataFrame, limit: int = DEFAULT_LIMIT, regions: Sequence[str] | None = None) -> DataFrame:
    """The rows :func:`classify_rows` calls kept, as plain conjuncts the optimizer can split."""
    rows = typed_rows(raw).where(~_short_row(raw))
    rows = rows.where(F.col("price_won") <= limit).where(F.col("area_m2") > 0).where(F.col("code").isNotNull())
    return rows.where(F.col("code").isin(*regions)) if regions else rows


def row_accounting(classified: DataFrame) -> DataFrame:
    """One row: total, kept, skipped."""
    return classified.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "kept").alias("kept"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )


def listing_items(kept: DataFrame) -> DataFrame:
    """Listing rows of the kept price rows."""

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) if name in kept.columns else F.lit("")

    kind = N.normal_type(F.col("type")) if "type" in kept.columns else F.lit("기타")
    region = F.trim(F.concat(text("sido"), F.lit(" "), text("sigungu")))
    return kept.select(
        "code",
        F.when(region != "", region).otherwise(F.col("code")).alias("region"),
        text("eupmyeondong").alias("dong"),
        text("name").alias("name"),
        text("dong").alias("bld_dong"),
        text("ho").alias("ho"),
        kind.alias("type"),
        F.bround("area_m2", 2).alias("area"),
        F.col("price_won").alias("price"),
        N.price_per_m2(F.col("price_won"), F.col("area_m2")).alias("per_m2"),
    )


def district_index(items: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """District list with counts; the label is the smallest one seen in the district."""
    return items.groupBy("code").agg(
        F.min("region").alias("region"), F.lit(limit).cast("bigint").alias("price_limit"), F.count(F.lit(1)).alias("item_count")
    )


def browse(items: DataFrame, kind: str | None = None, band: str = "all") -> DataFrame:
    """Type and area filters; rows without an area drop out only under an area band."""
    low, high = AREA_BANDS[band]
    if kind:
        items = items.where(F.col("type") == kind)
    if band != "all":
        items = items.where((F.col("area") > 0) & (F.col("area") >= low) & (F.col("area") < high))
    return items


def by_price(items: DataFrame, *tie_break: str) -> DataFrame:
    return items.orderBy(F.col("price").asc(), *tie_break)


def by_price_per_m2(items: DataFrame, *tie_break: str) -> DataFrame:
    return items.orderBy(F.col("per_m2").asc_nulls_last(), *tie_break)


def upper_median_per_m2(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upper median (rank n div 2) of the price per square metre, unknown values ignored."""
    known = count_values(items.where(F.col("per_m2").isNotNull()), keys, "per_m2")
    n = F.col("n")
    return pick_ranks(known, keys, "per_m2", {"median_per_m2": F.floor(n / 2)}, PRICE_PERM2_SLICE)

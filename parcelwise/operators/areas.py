"""Neighbourhood price statistics and their evaluation against a deposit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guarantee as G
from ..functions import numbers as N
from .order_stats import count_values, pick_ranks

MIN_SAMPLE = 5


def clean_units(raw: DataFrame) -> DataFrame:
    """Target-type price rows with a positive price, a numeric district code and a dong name.

    Without a ``type`` column no type filter applies.  Text columns come from the price file.
    """
    rows = raw.where(N.is_target_type(F.col("type"))) if "type" in raw.columns else raw
    label = F.trim(F.coalesce(F.col("sigungu"), F.lit(""))) if "sigungu" in raw.columns else F.lit("")
    return rows.select(
        N.district_code(F.col("ldcode"), strict=True).alias("code"),
        F.trim(F.coalesce(F.col("eupmyeondong"), F.lit(""))).alias("dong"),
        label.alias("region"),
        N.parse_price_plain(F.col("price")).alias("price"),
    ).where((F.col("price") > 0) & F.col("code").isNotNull() & (F.col("dong") != ""))


def accounting(raw: DataFrame) -> DataFrame:
    """Rows read, kept by :func:`clean_units`, and rejected by the first reason that holds."""
    target = F.coalesce(N.is_target_type(F.col("type")), F.lit(False)) if "type" in raw.columns else F.lit(True)
    reason = (
        F.when(~target, "type")
        .when(~F.coalesce(N.parse_price_plain(F.col("price")) > 0, F.lit(False)), "price")
        .when(N.district_code(F.col("ldcode"), strict=True).isNull(), "code")
        .when(F.trim(F.coalesce(F.col("eupmyeondong"), F.lit(""))) == "", "dong")
        .otherwise("kept")
    )
    counts = [F.count_if(F.col("_r") == r).alias(f"bad_{r}") for r in ("type", "price", "code", "dong")]
    return raw.select(reason.alias("_r")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_r") == "kept").alias("kept"), F.count_if(F.col("_r") != "kept").alias("skipped"), *counts
    )


def target_units(units: DataFrame) -> DataFrame:
    """The same selection on rows that are typed already (code, dong, type, price)."""
    return units.where(N.is_target_type(F.col("type")) & (F.col("price") > 0) & (F.col("dong") != "")).select("code", "dong", "price")


def value_counts(units: DataFrame) -> DataFrame:
    """(code, dong, price, cnt), the single pass over unit rows everything below is built on."""
    return count_values(units, ["code", "dong"], "price")


def _bins(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At most 51 rows per group: counts, exact price sum and extremes of every histogram bin."""
    amount = F.col("price").cast("decimal(19,0)") * F.col("cnt").cast("decimal(19,0)")
    return counted.groupBy(*keys, G.histogram_bin(F.col("price")).alias("bin")).agg(
        F.sum("cnt").alias("cnt"), F.sum(amount).alias("amount"), F.min("price").alias("lo"), F.max("price").alias("hi")
    )


def histogram_column() -> Column:
    """Dense 51-element array from the (bin, cnt) rows of one group."""
    entries = F.map_from_entries(F.collect_list(F.struct("bin", "cnt")))
    return F.transform(
        F.sequence(F.lit(0), F.lit(G.BIN_COUNT)),
        lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0).cast("bigint")),
    )


def moments(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, truncated mean, extremes and histogram per group."""
    merged = _bins(counted, keys).groupBy(*keys).agg(
        F.sum("cnt").alias("count"),
        F.sum("amount").alias("amount"),
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
        histogram_column().alias("hist"),
    )
    return merged.withColumn("avg", F.floor(F.col("amount") / F.col("count")).cast("bigint")).drop("amount")


def _ranks() -> dict[str, Column]:
    n = F.col("n")
    return {
        "_mid_low": F.floor((n - 1) / 2),
        "_mid_high": F.floor(n / 2),
        "p25": F.floor(n / 4),
        "p75": F.floor(n * 3 / 4),
    }


def price_stats(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """count, avg, median, p25, p75, min, max and histogram of every group.

    The quartiles are the elements at n div 4 and 3n div 4, not interpolated; the median is the mean
    of the middle two, truncated.
    """
    keys = list(keys)
    ranks = pick_ranks(counted, keys, "price", _ranks())
    median = F.floor((F.col("_mid_low") + F.col("_mid_high")) / 2).cast("bigint")
    return (
        moments(counted, keys)
        .join(ranks, keys)
        .select(*keys, "count", "avg", median.alias("median"), "p25", "p75", "min", "max", "hist")
    )


def dong_stats(counted: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Statistics per (code, dong); neighbourhoods under the minimum sample are left out."""
    return price_stats(counted, ["code", "dong"]).where(F.col("count") >= min_sample)


def kept_districts(counted: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Per district: number of kept neighbourhoods and the units in them."""
    per_dong = counted.groupBy("code", "dong").agg(F.sum("cnt").alias("n")).where(F.col("n") >= min_sample)
    return per_dong.groupBy("code").agg(F.count(F.lit(1)).alias("area_count"), F.sum("n").alias("total_count"))


def district_stats(counted: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """District roll-up over all units, including neighbourhoods under the minimum sample.

    A district without any kept neighbourhood vanishes.
    """
    rolled = counted.groupBy("code", "price").agg(F.sum("cnt").alias("cnt"))
    stats = price_stats(rolled, ["code"]).select("code", "count", "avg", "median", "hist")
    kept = kept_districts(counted, min_sample)
    return stats.join(kept, "code").withColumn("sido", F.substring("code", 1, 2))


def district_labels(units: DataFrame) -> DataFrame:
    """One label per district: the smallest non-blank one, the code where there is none."""
    label = F.min(F.when(F.col("region") != "", F.col("region")))
    return units.groupBy("code").agg(F.coalesce(label, F.col("code")).alias("region"))


def short_label(region: Column) -> Column:
    """Last word of a district label."""
    return F.element_at(F.split(region, r"\s+"), -1)


def sido_list(index: DataFrame) -> DataFrame:
    """Provinces: two-digit code and the first word of the label of their first district."""
    return index.groupBy(F.substring("code", 1, 2).alias("sido")).agg(
        F.get(F.split(F.min_by("region", "code"), r"\s+"), F.lit(0)).alias("name")
    )


def with_coordinates(areas: DataFrame, coordinates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Optional coordinates; a neighbourhood the table does not know keeps nulls."""
    known = coordinates.groupBy(*keys).agg(F.min(F.struct("lat", "lon")).alias("_c"))
    return areas.join(known, list(keys), "left").select(
        *[F.col(c) for c in areas.columns],
        F.bround(F.col("_c.lat"), 6).alias("lat"),
        F.bround(F.col("_c.lon"), 6).alias("lon"),
    )


def evaluate(areas: DataFrame, scenarios: Sequence[tuple[int, int]], policy: G.Policy = G.POLICY) -> DataFrame:
    """Every area against every (deposit, senior claims) scenario given as parameters."""
    listed = F.array(
        *[F.struct(F.lit(d).cast("bigint").alias("deposit"), F.lit(s).cast("bigint").alias("senior")) for d, s in scenarios]
    )
    rows = areas.withColumn("_s", F.explode(listed)).select(*areas.columns, "_s.deposit", "_s.senior")
    return (
        rows.withColumn("need", G.required_price(F.col("deposit"), F.col("senior"), policy))
        .withColumn("ratio", G.ratio_at_least(F.col("hist"), F.col("need")))
        .withColumn("grade", G.grade(F.col("ratio")))
        .withColumn("avg_max_deposit", G.max_deposit(F.col("avg"), F.col("senior"), policy))
        .withColumn("median_max_deposit", G.max_deposit(F.col("median"), F.col("senior"), policy))
    )


def grade_buckets(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Areas per grade, in the order the grades are shown."""
    return evaluated.where(F.col("ratio").isNotNull()).groupBy(*keys, "grade").agg(F.count(F.lit(1)).alias("areas")).withColumn(
        "grade_rank", G.grade_rank(F.col("grade"))
    )

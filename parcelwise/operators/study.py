"""How well group medians and quantiles approximate single unit prices.

Rows: ``housing_type, area, price, sido, sigungu, dong, dong_code`` (numbers or number texts).
Group statistics go through value counts, so no group is ever gathered in one task; group tables are
joined without a hint, Spark broadcasts them only when their measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..session import stored
from .order_stats import count_values, interpolated_quantiles

# Fixed values of the study.
AREA_EDGES = (0, 30, 45, 60, 85)
AREA_LABELS = ("~30", "30~45", "45~60", "60~85", "85~")
THRESHOLDS = (100_000_000, 159_000_000, 200_000_000, 300_000_000)
PRIMARY = 159_000_000
MIN_GROUP = 5
MAX_AREA = 500
UNIT_PRICE_RANGE = (10_000, 100_000_000)
ALL = "전체"
MODELS = {
    "du": "동 단일 ㎡당 중앙단가", "dbu": "동×면적구간 ㎡당 중앙단가", "p50": "동 공시가 P50", "bp50": "동×면적구간 공시가 P50",
}
QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
BIN = 10_000_000

UNIT_SLICE = 10_000.0
PRICE_SLICE = 1_000_000.0
RATIO_SLICE = 0.001


def area_bin(area: Column) -> Column:
    """Left-closed area class; null outside all classes."""
    chain = F.when(area < AREA_EDGES[0], F.lit(None).cast("string"))
    for edge, label in zip(AREA_EDGES[1:], AREA_LABELS):
        chain = chain.when(area < edge, F.lit(label))
    return chain.when(area >= AREA_EDGES[-1], F.lit(AREA_LABELS[-1]))


def region_class(sido: Column) -> Column:
    return F.when(sido.contains("서울"), "서울").when(sido.rlike("경기|인천"), "수도권기타").otherwise("지방")


def group_key(dong_code: Column, sido: Column, sigungu: Column, dong: Column) -> Column:
    """Legal-dong code where it is long enough, else the three names."""
    code = F.trim(F.regexp_replace(F.coalesce(dong_code.cast("string"), F.lit("")), r"\.0$", ""))
    names = F.concat_ws("|", F.coalesce(sido, F.lit("")), F.coalesce(sigungu, F.lit("")), F.coalesce(dong, F.lit("")))
    return F.when(F.length(code) >= 8, code).otherwise(names)


def typed(raw: DataFrame) -> DataFrame:
    """Target types with numeric area and price; unreadable numbers are null."""
    rows = raw.where(N.is_target_type(F.col("housing_type")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in raw.columns else F.lit("")
    return rows.select(
        N.parse_area(F.col("area")).alias("area"), N.parse_area(F.col("price")).alias("price"), text("sido").alias("sido"),
        group_key(F.col("dong_code") if "dong_code" in raw.columns else F.lit(""), text("sido"), text("sigungu"), text("dong")).alias("group"),
    )


def _positive() -> Column:
    return (F.col("area") > 0) & (F.col("price") > 0)


def _plausible() -> Column:
    unit = F.col("price") / F.col("area")
    return (F.col("area") <= MAX_AREA) & unit.between(*UNIT_PRICE_RANGE)


def cleaning_report(rows: DataFrame) -> DataFrame:
    """Rows rejected per reason; one row may count as missing and as not positive."""
    missing = F.col("area").isNull() | F.col("price").isNull()
    nonpositive = F.coalesce(F.col("area") <= 0, F.lit(False)) | F.coalesce(F.col("price") <= 0, F.lit(False))
    usable = F.coalesce(_positive(), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(missing).alias("bad_missing"),
        F.count_if(nonpositive).alias("bad_nonpositive"),
        F.count_if(usable & ~F.when(usable, _plausible())).alias("bad_implausible"),
    )


def plausible_rows(rows: DataFrame) -> DataFrame:
    """Usable rows with unit price, region and area class."""
    return rows.where(_positive()).where(_plausible()).select(
        "group", "area", "price", (F.col("price") / F.col("area")).alias("unit_price"), region_class(F.col("sido")).alias("region"),
        area_bin(F.col("area")).alias("area_bin"),
    )


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def excluded_report(rows: DataFrame) -> DataFrame:
    """Groups and rows under the minimum group size."""
    small = F.col("n") < MIN_GROUP
    return group_sizes(rows).agg(
        F.count_if(small).alias("excluded_groups"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).cast("bigint").alias("excluded_rows"),
        F.count_if(~small).alias("groups"), F.coalesce(F.sum(F.when(~small, F.col("n"))), F.lit(0)).cast("bigint").alias("rows"),
    )


def keep_large_groups(rows: DataFrame) -> DataFrame:
    return rows.join(group_sizes(rows).where(F.col("n") >= MIN_GROUP).select("group"), "group", "left_semi")


def dispersion(rows: DataFrame) -> DataFrame:
    """Spread of the unit price within every group."""
    base = rows.groupBy("group").agg(
        F.avg("unit_price").alias("mean"), F.stddev_samp("unit_price").alias("sd"), F.min("region").alias("region")
    )
    spread = interpolated_quantiles(count_values(rows, ["group"], "unit_price"), ["group"], "unit_price", QUANTILES, UNIT_SLICE)
    c = F.col
    return spread.join(base, "group").select(
        "group", "region", "n", "mean", "sd", *QUANTILES, (c("sd") / c("mean")).alias("cv"), ((c("p75") - c("p25")) / c("p50")).alias("iqr_ratio"),
        ((c("p90") - c("p10")) / c("p50")).alias("p10_p90_width"), (c("p90") / c("p10")).alias("multiple"),
    )


def _scoped(rows: DataFrame) -> DataFrame:
    """Every row once for the whole and once for its region."""
    return rows.withColumn("scope", F.explode(F.array(F.lit(ALL), F.col("region"))))


def _metric_rows(groups: DataFrame, metrics: Sequence[str]) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    keep = [c for c in ("scope",) if c in groups.columns]
    return groups.select(*keep, F.explode(listed).alias("m")).select(*keep, "m.metric", "m.value").where(F.col("value").isNotNull())


def dispersion_summary(groups: DataFrame) -> DataFrame:
    """Dispersion over all groups and per region."""
    scoped = _scoped(groups)
    base = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("dongs"), F.sum("n").alias("rows"), F.avg("cv").alias("mean_cv"),
        F.avg((F.col("cv") < 0.2).cast("double")).alias("pct_cv_lt_0_2"), F.avg((F.col("cv") >= 0.4).cast("double")).alias("pct_cv_ge_0_4"),
    )
    metrics = _metric_rows(scoped, ["cv", "iqr_ratio", "p10_p90_width", "multiple"])
    medians = interpolated_quantiles(count_values(metrics, ["scope", "metric"], "value"), ["scope", "metric"], "value", {"median": 0.5}, RATIO_SLICE)
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("median")))
    wide = medians.groupBy("scope").agg(
        pick("cv").alias("median_cv"), pick("iqr_ratio").alias("median_iqr_ratio"), pick("p10_p90_width").alias("median_p10_p90_width"),
        pick("multiple").alias("median_p90_p10_multiple"),
    )
    return base.join(wide, "scope")


def metric_distribution(groups: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quantiles of the dispersion metrics."""
    metrics = _metric_rows(groups, ["n", "cv", "iqr_ratio", "p10_p90_width", "multiple"])
    base = metrics.groupBy("metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    spread = interpolated_quantiles(count_values(metrics, ["metric"], "value"), ["metric"], "value", QUANTILES, RATIO_SLICE).drop("n")
    return base.join(spread, "metric")


def area_bin_table(rows: DataFrame) -> DataFrame:
    """Unit prices per area class, over all and per region; empty classes are kept."""
    counted = rows.groupBy("region", "area_bin", "unit_price").agg(F.count(F.lit(1)).alias("cnt"), F.sum("price").alias("price_sum"))
    scoped = counted.withColumn("scope", F.explode(F.array(F.lit(ALL), F.col("region"))))
    # Read four times: for slices, ranks, sums and scopes.
    values = stored(scoped.groupBy("scope", "area_bin", "unit_price").agg(F.sum("cnt").alias("cnt"), F.sum("price_sum").alias("price_sum")), "area-values")
    median = interpolated_quantiles(values, ["scope", "area_bin"], "unit_price", {"median_unit": 0.5}, UNIT_SLICE).drop("n")
    base = values.groupBy("scope", "area_bin").agg(
        F.sum("cnt").alias("n"), (F.sum(F.col("unit_price") * F.col("cnt")) / F.sum("cnt")).alias("mean_unit"), (F.sum("price_sum") / F.sum("cnt")).alias("mean_price")
    )
    classes = values.select("scope").distinct().withColumn("area_bin", F.explode(F.array(*[F.lit(x) for x in AREA_LABELS])))
    joined = classes.join(base, ["scope", "area_bin"], "left").join(median, ["scope", "area_bin"], "left")
    return joined.select("scope", "area_bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_unit", "median_unit", "mean_price")


def demeaned(rows: DataFrame, column: str) -> DataFrame:
    """Group mean attached to every row (a join with the group table, not a window over the group)."""
    means = rows.groupBy("group").agg(F.avg(column).alias("group_mean"))
    return rows.join(means, "group").withColumn("deviation", F.col(column) - F.col("group_mean"))


def fixed_effect_slopes(rows: DataFrame) -> DataFrame:
    """Within-group slope of unit price and of its logarithm on area, pooled and per region.

    Group covariances combine map-side; summed over groups they equal the slope of demeaned rows.
    """
    logged = rows.withColumn("log_price", F.ln("unit_price"))
    per_group = logged.groupBy("group", "region").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("area").alias("vx"), F.covar_pop("area", "unit_price").alias("cy"), F.covar_pop("area", "log_price").alias("cl")
    )
    c = F.col
    pooled = _scoped(per_group).groupBy("scope").agg(
        (F.sum(c("cy") * c("n")) / F.nullif(F.sum(c("vx") * c("n")), F.lit(0.0))).alias("won_slope"),
        (F.sum(c("cl") * c("n")) / F.nullif(F.sum(c("vx") * c("n")), F.lit(0.0))).alias("log_slope"),
    )
    return pooled.withColumn("pct_for_10m2", (F.exp(c("log_slope") * 10) - 1) * 100)


def split_bucket() -> Column:
    """Stable bucket 0..4 of a row; 0 is the test set."""
    text = F.concat_ws("|", "group", F.col("area").cast("decimal(12,2)").cast("string"), F.col("price").cast("decimal(20,0)").cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 5).cast("int")


def train_test(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("bucket", split_bucket())
    return marked.where("bucket <> 0").drop("bucket"), marked.where("bucket = 0").drop("bucket")


def training_stats(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Median unit price and price quartiles per group and per (group, area class).

    Each value column is counted once, per class; the counts of a group are the sums over its classes.
    """
    by_bin = ["group", "area_bin"]
    units, prices = (stored(count_values(train, by_bin, value), f"training-{value}") for value in ("unit_price", "price"))

    def counted(table: DataFrame, keys: list[str], value: str) -> DataFrame:
        return table if keys == by_bin else table.groupBy(*keys, value).agg(F.sum("cnt").alias("cnt"))

    def stats(keys: list[str], prefix: str) -> DataFrame:
        unit = interpolated_quantiles(counted(units, keys, "unit_price"), keys, "unit_price", {f"{prefix}unit": 0.5}, UNIT_SLICE).drop("n")
        price = interpolated_quantiles(
            counted(prices, keys, "price"), keys, "price", {f"{prefix}p25": 0.25, f"{prefix}p50": 0.5, f"{prefix}p75": 0.75}, PRICE_SLICE
        ).drop("n")
        return unit.join(price, keys)

    return stats(["group"], "g_"), stats(by_bin, "b_")


def predict(test: DataFrame, by_group: DataFrame, by_bin: DataFrame) -> DataFrame:
    """Test rows with the four predictions and two quartile intervals; the class falls back to the group."""
    joined = test.join(by_group, "group", "left").join(by_bin, ["group", "area_bin"], "left")
    c = F.col
    return joined.select(
        "group", "region", "area_bin", "area", "price", (c("g_unit") * c("area")).alias("du"), (F.coalesce("b_unit", "g_unit") * c("area")).alias("dbu"),
        c("g_p50").alias("p50"), F.coalesce("b_p50", "g_p50").alias("bp50"), c("g_p25").alias("lo"), c("g_p75").alias("hi"),
        F.coalesce("b_p25", "g_p25").alias("blo"), F.coalesce("b_p75", "g_p75").alias("bhi"),
    )


def _model_rows(predicted: DataFrame) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in MODELS])
    rows = predicted.select("region", "price", F.explode(listed).alias("m")).select("region", "price", "m.model", "m.prediction")
    return rows.where(F.col("prediction").isNotNull() & (F.col("price") > 0))


def model_errors(predicted: DataFrame, keys: Sequence[str] = (), thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Errors of every model at every threshold; all thresholds in one aggregation."""
    rows = _model_rows(predicted)
    price, guess = F.col("price"), F.col("prediction")
    sums = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(guess - price) / price).alias("ape")]
    for i, limit in enumerate(thresholds):
        sums += [
            F.count_if((price >= limit) & (guess < limit)).alias(f"fn{i}"), F.count_if((price < limit) & (guess >= limit)).alias(f"fp{i}"),
            F.count_if(price >= limit).alias(f"pos{i}"),
        ]
    totals = rows.groupBy(*keys, "model").agg(*sums)
    per_limit = F.array(
        *[
            F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"fn{i}").alias("fn"), F.col(f"fp{i}").alias("fp"), F.col(f"pos{i}").alias("pos"))
            for i, t in enumerate(thresholds)
        ]
    )
    long = totals.select(*keys, "model", "n", "ape", F.explode(per_limit).alias("t")).select(*keys, "model", "n", "ape", "t.*")
    c = F.col
    return long.select(
        *keys, "model", "threshold", "n", (c("ape") * 100).alias("mape_pct"), ((c("fn") + c("fp")) / c("n") * 100).alias("misclassification_pct"),
        (c("fn") / c("n") * 100).alias("fn_total_pct"), (c("fp") / c("n") * 100).alias("fp_total_pct"),
        (c("fn") / F.greatest(c("pos"), F.lit(1)) * 100).alias("fn_cond_pct"), (c("fp") / F.greatest(c("n") - c("pos"), F.lit(1)) * 100).alias("fp_cond_pct"),
    )


def interval_decisions(predicted: DataFrame, threshold: int = PRIMARY) -> DataFrame:
    """Yes / no / undecided by quartile interval: coverage and errors."""
    listed = F.array(
        F.struct(F.lit("group").alias("interval"), F.col("lo").alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.lit("group_bin").alias("interval"), F.col("blo").alias("lo"), F.col("bhi").alias("hi")),
    )
    rows = predicted.select("price", F.explode(listed).alias("i")).select("price", "i.*")
    decision = F.when(F.col("lo") >= threshold, 1).when(F.col("hi") < threshold, 0)
    wrong = F.col("decision") != (F.col("price") >= threshold).cast("int")
    totals = rows.withColumn("decision", decision).groupBy("interval").agg(
        F.count(F.lit(1)).alias("n"), F.count("decision").alias("decided"), F.count_if(wrong).alias("wrong")
    )
    c = F.col
    return totals.select(
        "interval", (c("decided") / c("n") * 100).alias("coverage_pct"), (c("wrong") / F.nullif(c("decided"), F.lit(0)) * 100).alias("misclassification_among_decided_pct"),
        (c("wrong") / c("n") * 100).alias("overall_wrong_pct"), ((c("n") - c("decided")) / c("n") * 100).alias("uncertain_pct"),
    )


def histogram_approximation(train: DataFrame, test: DataFrame, threshold: int = PRIMARY) -> DataFrame:
    """Share over a threshold from 10-million-won bins of the training rows against the true test share."""
    bins = train.groupBy("group", F.floor(F.col("price") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    over = F.col("bin") * BIN + BIN // 2 >= threshold
    stored_bins = bins.groupBy("group").agg(F.count(F.lit(1)).alias("bins"), (F.sum(F.when(over, F.col("c")).otherwise(0)) / F.sum("c")).alias("approx"))
    truth = test.groupBy("group").agg(F.avg((F.col("price") >= threshold).cast("double")).alias("share"))
    return truth.join(stored_bins, "group").agg(
        F.count(F.lit(1)).alias("groups"), (F.avg("bins") * 2).alias("numbers_per_dong"), (F.avg(F.abs(F.col("approx") - F.col("share"))) * 100).alias("pass_share_mae_pp")
    )

"""The approximation study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import study as S
from ...session import scratch_path, stored
from ...sources.views import view, with_views
from ..study import run_study


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat("code", F.lit("00"), F.substring("dong", 2, 1), F.lit("00.0"))
    return view(spark, sf, "housing_units").select(
        F.col("type").alias("housing_type"), "area", F.col("price").cast("string").alias("price"), "sido", F.col("code").alias("sigungu"), "dong",
        F.when(F.col("dong") != "D7", code).otherwise("").alias("dong_code"),
    )


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    # The sizes of the groups read the rows a second time.
    return S.keep_large_groups(stored(S.plausible_rows(S.typed(_raw(spark, sf))), "plausible"))


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with missing, negative and implausible numbers."""
    raw = view(spark, sf, "raw_price_rows")
    area = F.when(F.col("row_id").cast("bigint") % 67 == 0, "700").otherwise(F.col("area"))
    return raw.select(F.col("type").alias("housing_type"), area.alias("area"), "price", "sido", "sigungu", F.col("eupmyeondong").alias("dong"))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def p08_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    return S.cleaning_report(S.typed(_dirty(spark, sf)))


def p11_group_keys(spark: SparkSession, sf: str) -> DataFrame:
    return S.typed(_raw(spark, sf)).groupBy("group").agg(F.count(F.lit(1)).alias("rows"))


def p12_p13_classes(spark: SparkSession, sf: str) -> DataFrame:
    return S.plausible_rows(S.typed(_raw(spark, sf))).groupBy("region", "area_bin").agg(F.count(F.lit(1)).alias("rows"))


def a04_small_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups cut fine enough (code, dong, area) that many fall under five rows."""
    rows = S.plausible_rows(S.typed(_raw(spark, sf)))
    return S.excluded_report(rows.withColumn("group", F.concat_ws("|", "group", F.col("area").cast("int").cast("string"))))


def a10_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    groups = S.dispersion(_clean(spark, sf))
    return _rounded(_rounded(groups, 2, "mean", "sd", *S.QUANTILES), 6, "cv", "iqr_ratio", "p10_p90_width", "multiple")


def a11_dispersion_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = S.dispersion_summary(stored(S.dispersion(_clean(spark, sf)), "groups"))
    return _rounded(summary, 6, *[c for c in summary.columns if c not in ("scope", "dongs", "rows")])


def a12_metric_distribution(spark: SparkSession, sf: str) -> DataFrame:
    described = S.metric_distribution(stored(S.dispersion(_clean(spark, sf)), "groups"))
    return _rounded(described, 6, *[c for c in described.columns if c not in ("metric", "count")])


def a13_area_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.area_bin_table(_clean(spark, sf)), 2, "mean_unit", "median_unit", "mean_price")


def a14_area_effect(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_rounded(S.fixed_effect_slopes(_clean(spark, sf)), 3, "won_slope"), 6, "log_slope", "pct_for_10m2")


def w02_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.demeaned(_clean(spark, sf), "area")
    return rows.groupBy("group").agg(
        F.round(F.max("group_mean"), 6).alias("group_mean"), F.round(F.max("deviation"), 6).alias("max_deviation"), F.count(F.lit(1)).alias("rows")
    )


def k34_train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).groupBy(S.split_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum("price").cast("bigint").alias("price_sum"))


def a19_training_stats(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = S.train_test(stored(_clean(spark, sf), "study"))
    by_group, by_bin = S.training_stats(train)
    values = ("unit", "p25", "p50", "p75")
    whole = by_group.select("group", F.lit("").alias("area_bin"), *[F.col(f"g_{v}").alias(v) for v in values])
    return _rounded(whole.unionByName(by_bin.select("group", "area_bin", *[F.col(f"b_{v}").alias(v) for v in values])), 2, *values)


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    train, test = S.train_test(stored(_clean(spark, sf), "study"))
    return S.predict(test, *S.training_stats(train))


def j15_model_attach(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predicted(spark, sf).select("group", "area", F.col("price").cast("bigint").alias("price"), "du", "dbu", "p50", "bp50", "lo", "hi", "blo", "bhi")
    return _rounded(rows, 3, "du", "dbu", "p50", "bp50", "lo", "hi", "blo", "bhi")


_PCT = ("mape_pct", "misclassification_pct", "fn_total_pct", "fp_total_pct", "fn_cond_pct", "fp_cond_pct")


def a16_model_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.model_errors(_predicted(spark, sf)), 6, *_PCT)


def a16_model_errors_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.model_errors(_predicted(spark, sf), ["region"], [S.PRIMARY]), 6, *_PCT)


def a17_interval_decisions(spark: SparkSession, sf: str) -> DataFrame:
    decided = S.interval_decisions(_predicted(spark, sf))
    return _rounded(decided, 6, *[c for c in decided.columns if c != "interval"])


def a18_histogram_approximation(spark: SparkSession, sf: str) -> DataFrame:
    train, test = S.train_test(stored(_clean(spark, sf), "study"))
    return _rounded(S.histogram_approximation(train, test), 6, "numbers_per_dong", "pass_share_mae_pp")


# Key columns and rounding of every report's lines.
_REPORTS = {
    "cleaning": ([], {}), "excluded": ([], {}), "q1_summary": (["scope"], {}), "q1_metric_distribution": (["metric"], {}),
    "area_bins": (["scope", "area_bin"], {"mean_unit": 2, "median_unit": 2, "mean_price": 2}), "area_effect": (["scope"], {"won_slope": 3}),
    "models": (["model", "threshold"], {}), "models_by_region": (["region", "model", "threshold"], {}), "intervals": (["interval"], {}), "histogram": ([], {}),
}


def s15_study_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The whole study written as CSV; every report read back, one row for each of its numbers."""
    output = scratch_path(spark, "study-reports")
    reports = run_study(_raw(spark, sf), output)
    parts = []
    for name, (keys, digits) in _REPORTS.items():
        schema = ", ".join(f"`{c}` {'string' if c in keys else 'double'}" for c in reports[name].columns)
        lines = spark.read.option("header", True).schema(schema).csv(f"{output}/{name}")
        numbers = F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, digits.get(c, 6)).alias("value")) for c in lines.columns if c not in keys])
        rows = lines.select(F.lit(name).alias("report"), F.concat_ws("|", *keys).alias("line"), F.explode(numbers).alias("m"))
        parts.append(rows.select("report", "line", "m.measure", "m.value").where(F.col("value").isNotNull()))
    return reduce(DataFrame.unionAll, parts)


QUERIES = {
    f.__name__: f
    for f in (
        p08_cleaning, p11_group_keys, p12_p13_classes, a04_small_groups, a10_dispersion, a11_dispersion_summary, a12_metric_distribution,
        a13_area_bins, a14_area_effect, w02_group_mean, k34_train_test_split, a19_training_stats, j15_model_attach, a16_model_errors,
        a16_model_errors_by_region, a17_interval_decisions, a18_histogram_approximation, s15_study_outputs,
    )
}

_D = """d0 AS (SELECT CASE WHEN dong <> 'D7' THEN concat(code, '00', substr(dong, 2, 1), '00') ELSE concat(sido, '|', code, '|', dong) END AS grp, area, price, price / area AS unit_price,
 CASE WHEN contains(sido, '서울') THEN '서울' WHEN contains(sido, '경기') THEN '수도권기타' ELSE '지방' END AS region,
 CASE WHEN area < 30 THEN '~30' WHEN area < 45 THEN '30~45' WHEN area < 60 THEN '45~60' WHEN area < 85 THEN '60~85' ELSE '85~' END AS area_bin
 FROM housing_units WHERE type <> '아파트' AND area > 0 AND price > 0 AND area <= 500 AND price / area BETWEEN 10000 AND 100000000),
 d AS (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', grp, CAST(CAST(area AS DECIMAL(12,2)) AS VARCHAR), CAST(price AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS bucket
 FROM d0 WHERE grp IN (SELECT grp FROM d0 GROUP BY grp HAVING count(*) >= 5))"""
_G = f"""{_D}, q AS (SELECT grp, min(region) AS region, count(*) AS n, avg(unit_price) AS mean, stddev_samp(unit_price) AS sd, quantile_cont(unit_price, 0.1) AS p10, quantile_cont(unit_price, 0.25) AS p25,
 quantile_cont(unit_price, 0.5) AS p50, quantile_cont(unit_price, 0.75) AS p75, quantile_cont(unit_price, 0.9) AS p90 FROM d GROUP BY grp),
 g AS (SELECT *, sd / mean AS cv, (p75 - p25) / p50 AS iqr_ratio, (p90 - p10) / p50 AS p10_p90_width, p90 / p10 AS multiple FROM q)"""
_P = f"""{_D}, tr AS (SELECT * FROM d WHERE bucket <> 0), te AS (SELECT * FROM d WHERE bucket = 0),
 sg AS (SELECT grp, quantile_cont(unit_price, 0.5) AS u, quantile_cont(price::DOUBLE, 0.25) AS p25, quantile_cont(price::DOUBLE, 0.5) AS p50, quantile_cont(price::DOUBLE, 0.75) AS p75 FROM tr GROUP BY grp),
 sb AS (SELECT grp, area_bin, quantile_cont(unit_price, 0.5) AS u, quantile_cont(price::DOUBLE, 0.25) AS p25, quantile_cont(price::DOUBLE, 0.5) AS p50, quantile_cont(price::DOUBLE, 0.75) AS p75 FROM tr GROUP BY grp, area_bin),
 pr AS (SELECT te.grp, te.region, te.area, te.price, sg.u * area AS du, coalesce(sb.u, sg.u) * area AS dbu, sg.p50 AS p50, coalesce(sb.p50, sg.p50) AS bp50, sg.p25 AS lo, sg.p75 AS hi,
 coalesce(sb.p25, sg.p25) AS blo, coalesce(sb.p75, sg.p75) AS bhi FROM te LEFT JOIN sg ON sg.grp = te.grp LEFT JOIN sb ON sb.grp = te.grp AND sb.area_bin = te.area_bin),
 mr AS (SELECT region, price, 'du' AS model, du AS p FROM pr UNION ALL SELECT region, price, 'dbu', dbu FROM pr UNION ALL SELECT region, price, 'p50', p50 FROM pr UNION ALL SELECT region, price, 'bp50', bp50 FROM pr)"""


def _errors(keys: str, limits: str) -> str:
    return f"""SELECT {keys} model, threshold, count(*) AS n, round(avg(abs(p - price) / price) * 100, 6) AS mape_pct,
 round(count(*) FILTER ((price >= threshold) <> (p >= threshold)) / count(*) * 100, 6) AS misclassification_pct,
 round(count(*) FILTER (price >= threshold AND p < threshold) / count(*) * 100, 6) AS fn_total_pct, round(count(*) FILTER (price < threshold AND p >= threshold) / count(*) * 100, 6) AS fp_total_pct,
 round(count(*) FILTER (price >= threshold AND p < threshold) / greatest(1, count(*) FILTER (price >= threshold)) * 100, 6) AS fn_cond_pct,
 round(count(*) FILTER (price < threshold AND p >= threshold) / greatest(1, count(*) FILTER (price < threshold)) * 100, 6) AS fp_cond_pct
 FROM mr CROSS JOIN (SELECT unnest([{limits}])::BIGINT AS threshold) WHERE p IS NOT NULL GROUP BY {keys} model, threshold"""


_SCOPES = "(SELECT '전체' AS scope, * FROM {t} UNION ALL SELECT region AS scope, * FROM {t})"
_SIGNED = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_NUM = "CASE WHEN regexp_matches(trim(replace(replace({c}, ',', ''), '\"', '')), " + _SIGNED + ") THEN TRY_CAST(trim(replace(replace({c}, ',', ''), '\"', '')) AS DOUBLE) END"

ORACLES = {
    "p08_cleaning": with_views(
        f"""WITH t AS (SELECT {_NUM.format(c="CASE WHEN CAST(row_id AS BIGINT) % 67 = 0 THEN '700' ELSE area END")} AS area, {_NUM.format(c='price')} AS price FROM raw_price_rows WHERE regexp_matches(type, '연립|다세대'))
        SELECT count(*) AS rows_before, count(*) FILTER (area IS NULL OR price IS NULL) AS bad_missing, count(*) FILTER (area <= 0 OR price <= 0) AS bad_nonpositive,
        count(*) FILTER (area > 0 AND price > 0 AND (area > 500 OR price / area < 10000 OR price / area > 100000000)) AS bad_implausible FROM t""",
        "raw_price_rows",
    ),
    "p11_group_keys": with_views(
        "SELECT CASE WHEN dong <> 'D7' THEN concat(code, '00', substr(dong, 2, 1), '00') ELSE concat(sido, '|', code, '|', dong) END AS \"group\", count(*) AS rows FROM housing_units WHERE type <> '아파트' GROUP BY 1",
        "housing_units",
    ),
    "p12_p13_classes": with_views(f"WITH {_D} SELECT region, area_bin, count(*) AS rows FROM d0 GROUP BY ALL", "housing_units"),
    "a04_small_groups": with_views(
        f"""WITH {_D}, c AS (SELECT count(*) AS n FROM d0 GROUP BY grp, area) SELECT count(*) FILTER (n < 5) AS excluded_groups, CAST(coalesce(sum(n) FILTER (n < 5), 0) AS BIGINT) AS excluded_rows,
        count(*) FILTER (n >= 5) AS groups, CAST(coalesce(sum(n) FILTER (n >= 5), 0) AS BIGINT) AS rows FROM c""",
        "housing_units",
    ),
    "a10_dispersion": with_views(
        f"""WITH {_G} SELECT grp AS "group", region, n, round(mean, 2) AS mean, round(sd, 2) AS sd, round(p10, 2) AS p10, round(p25, 2) AS p25, round(p50, 2) AS p50, round(p75, 2) AS p75, round(p90, 2) AS p90,
        round(cv, 6) AS cv, round(iqr_ratio, 6) AS iqr_ratio, round(p10_p90_width, 6) AS p10_p90_width, round(multiple, 6) AS multiple FROM g""",
        "housing_units",
    ),
    "a11_dispersion_summary": with_views(
        f"""WITH {_G} SELECT scope, count(*) AS dongs, CAST(sum(n) AS BIGINT) AS rows, round(avg(cv), 6) AS mean_cv, round(avg(CASE WHEN cv < 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_cv_lt_0_2,
        round(avg(CASE WHEN cv >= 0.4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_cv_ge_0_4, round(quantile_cont(cv, 0.5), 6) AS median_cv, round(quantile_cont(iqr_ratio, 0.5), 6) AS median_iqr_ratio,
        round(quantile_cont(p10_p90_width, 0.5), 6) AS median_p10_p90_width, round(quantile_cont(multiple, 0.5), 6) AS median_p90_p10_multiple FROM {_SCOPES.format(t='g')} GROUP BY scope""",
        "housing_units",
    ),
    "a12_metric_distribution": with_views(
        f"""WITH {_G}, m AS (SELECT 'n' AS metric, n::DOUBLE AS v FROM g UNION ALL SELECT 'cv', cv FROM g UNION ALL SELECT 'iqr_ratio', iqr_ratio FROM g UNION ALL SELECT 'p10_p90_width', p10_p90_width FROM g UNION ALL SELECT 'multiple', multiple FROM g)
        SELECT metric, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25,
        round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90 FROM m GROUP BY metric""",
        "housing_units",
    ),
    "a13_area_bins": with_views(
        f"""WITH {_D}, s AS {_SCOPES.format(t='d')}, c AS (SELECT * FROM (SELECT DISTINCT scope FROM s) CROSS JOIN (SELECT unnest(['~30', '30~45', '45~60', '60~85', '85~']) AS area_bin))
        SELECT c.scope, c.area_bin, count(price) AS n, round(avg(unit_price), 2) AS mean_unit, round(quantile_cont(unit_price, 0.5), 2) AS median_unit, round(avg(price::DOUBLE), 2) AS mean_price
        FROM c LEFT JOIN s ON s.scope = c.scope AND s.area_bin = c.area_bin GROUP BY c.scope, c.area_bin""",
        "housing_units",
    ),
    "a14_area_effect": with_views(
        f"""WITH {_D}, s AS {_SCOPES.format(t='d')}, x AS (SELECT scope, area - avg(area) OVER w AS dx, unit_price - avg(unit_price) OVER w AS dy, ln(unit_price) - avg(ln(unit_price)) OVER w AS dl FROM s WINDOW w AS (PARTITION BY scope, grp)),
        e AS (SELECT scope, sum(dx * dy) / sum(dx * dx) AS won_slope, sum(dx * dl) / sum(dx * dx) AS log_slope FROM x GROUP BY scope)
        SELECT scope, round(won_slope, 3) AS won_slope, round(log_slope, 6) AS log_slope, round((exp(log_slope * 10) - 1) * 100, 6) AS pct_for_10m2 FROM e""",
        "housing_units",
    ),
    "w02_group_mean": with_views(
        f"""WITH {_D} SELECT grp AS "group", round(avg(area), 6) AS group_mean, round(max(area) - avg(area), 6) AS max_deviation, count(*) AS rows FROM d GROUP BY grp""", "housing_units"
    ),
    "k34_train_test_split": with_views(
        f"WITH {_D} SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS rows, CAST(sum(price) AS BIGINT) AS price_sum FROM d GROUP BY 1", "housing_units"
    ),
    "a19_training_stats": with_views(
        f"""WITH {_P} SELECT grp AS "group", area_bin, round(u, 2) AS unit, round(p25, 2) AS p25, round(p50, 2) AS p50, round(p75, 2) AS p75
        FROM (SELECT grp, '' AS area_bin, u, p25, p50, p75 FROM sg UNION ALL SELECT grp, area_bin, u, p25, p50, p75 FROM sb)""", "housing_units"
    ),
    "j15_model_attach": with_views(
        f"""WITH {_P} SELECT grp AS "group", area, price, round(du, 3) AS du, round(dbu, 3) AS dbu, round(p50, 3) AS p50, round(bp50, 3) AS bp50, round(lo, 3) AS lo, round(hi, 3) AS hi, round(blo, 3) AS blo, round(bhi, 3) AS bhi FROM pr""",
        "housing_units",
    ),
    "a16_model_errors": with_views(f"WITH {_P} {_errors('', '100000000, 159000000, 200000000, 300000000')}", "housing_units"),
    "a16_model_errors_by_region": with_views(f"WITH {_P} {_errors('region,', '159000000')}", "housing_units"),
    "a17_interval_decisions": with_views(
        f"""WITH {_P}, i AS (SELECT 'group' AS interval, price, lo, hi FROM pr UNION ALL SELECT 'group_bin', price, blo, bhi FROM pr),
        x AS (SELECT *, CASE WHEN lo >= 159000000 THEN 1 WHEN hi < 159000000 THEN 0 END AS decision, CASE WHEN price >= 159000000 THEN 1 ELSE 0 END AS truth FROM i)
        SELECT interval, round(count(decision) / count(*) * 100, 6) AS coverage_pct, round(count(*) FILTER (decision <> truth) / count(decision) * 100, 6) AS misclassification_among_decided_pct,
        round(count(*) FILTER (decision <> truth) / count(*) * 100, 6) AS overall_wrong_pct, round(count(*) FILTER (decision IS NULL) / count(*) * 100, 6) AS uncertain_pct FROM x GROUP BY interval""",
        "housing_units",
    ),
    "a18_histogram_approximation": with_views(
        f"""WITH {_P}, b AS (SELECT grp, price // 10000000 AS bin, count(*) AS c FROM tr GROUP BY ALL), a AS (SELECT grp, count(*) AS bins, sum(CASE WHEN bin * 10000000 + 5000000 >= 159000000 THEN c ELSE 0 END) / sum(c) AS approx FROM b GROUP BY grp),
        t AS (SELECT grp, avg(CASE WHEN price >= 159000000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM te GROUP BY grp)
        SELECT count(*) AS groups, round(avg(bins) * 2, 6) AS numbers_per_dong, round(avg(abs(approx - share)) * 100, 6) AS pass_share_mae_pp FROM t JOIN a ON a.grp = t.grp""",
        "housing_units",
    ),
}

_REPORT_SQL = {
    "cleaning": with_views(
        "SELECT count(*) AS rows_before, 0 AS bad_missing, count(*) FILTER (area <= 0 OR price <= 0) AS bad_nonpositive, "
        "count(*) FILTER (area > 0 AND price > 0 AND (area > 500 OR price / area < 10000 OR price / area > 100000000)) AS bad_implausible FROM housing_units WHERE type <> '아파트'",
        "housing_units",
    ),
    "excluded": with_views(
        f"""WITH {_D}, c AS (SELECT count(*) AS n FROM d0 GROUP BY grp) SELECT count(*) FILTER (n < 5) AS excluded_groups, coalesce(sum(n) FILTER (n < 5), 0) AS excluded_rows,
        count(*) FILTER (n >= 5) AS groups, coalesce(sum(n) FILTER (n >= 5), 0) AS rows FROM c""",
        "housing_units",
    ),
    **{name: ORACLES[query] for name, query in {
        "q1_summary": "a11_dispersion_summary", "q1_metric_distribution": "a12_metric_distribution", "area_bins": "a13_area_bins", "area_effect": "a14_area_effect",
        "models": "a16_model_errors", "models_by_region": "a16_model_errors_by_region", "intervals": "a17_interval_decisions", "histogram": "a18_histogram_approximation",
    }.items()},
}


def _report_lines(name: str) -> str:
    """The numbers of one report's SQL, one row each."""
    keys, _ = _REPORTS[name]
    line = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    numbers = f"* EXCLUDE ({', '.join(keys)})" if keys else "*"
    return f"""SELECT '{name}' AS report, line, measure, value FROM (UNPIVOT (SELECT {line} AS line, CAST(COLUMNS({numbers}) AS DOUBLE) FROM ({_REPORT_SQL[name]}))
 ON COLUMNS(* EXCLUDE (line)) INTO NAME measure VALUE value)"""


ORACLES["s15_study_outputs"] = " UNION ALL ".join(_report_lines(name) for name in _REPORTS)

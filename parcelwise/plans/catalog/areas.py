"""Neighbourhood statistics and deposit evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import guarantee as G
from ...functions import numbers as N
from ...operators import areas as A
from ...operators.order_stats import count_values, pick_ranks
from ...sources.views import view, with_views

# (deposit, senior claims) pairs evaluated in the registered queries.
SCENARIOS = [(200_000_000, 0), (200_000_000, 80_000_000), (450_000_000, 150_000_000)]


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(A.target_units(view(spark, sf, "housing_units")))


def _joined(hist) -> object:
    return F.array_join(F.transform(hist, lambda n: n.cast("string")), ",")


def a01_dong_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.dong_stats(_counted(spark, sf)).select("code", "dong", "count", "avg", "median", "min", "max")


def a02_index_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    ranks = {"p25": F.floor(n / 4), "p75": F.floor(n * 3 / 4)}
    return pick_ranks(_counted(spark, sf), ["code", "dong"], "price", ranks).where(n >= A.MIN_SAMPLE)


def a03_price_histogram(spark: SparkSession, sf: str) -> DataFrame:
    stats = A.moments(_counted(spark, sf), ["code", "dong"])
    return stats.select("code", "dong", "count", _joined(F.col("hist")).alias("hist"))


def a04_minimum_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Small cells: units of one type and area value per dong, so that many fall under five rows."""
    kept = view(spark, sf, "housing_units").groupBy("code", "dong", "type", "area").agg(F.count(F.lit(1)).alias("n"))
    return kept.agg(
        F.count_if(F.col("n") >= A.MIN_SAMPLE).alias("kept_groups"),
        F.count_if(F.col("n") < A.MIN_SAMPLE).alias("dropped_groups"),
        F.coalesce(F.sum(F.when(F.col("n") < A.MIN_SAMPLE, F.col("n"))), F.lit(0)).cast("bigint").alias("dropped_rows"),
    )


def a05_district_rollup(spark: SparkSession, sf: str) -> DataFrame:
    stats = A.district_stats(_counted(spark, sf))
    return stats.select("code", "sido", "area_count", "count", "avg", "median", _joined(F.col("hist")).alias("hist"))


def a06_total_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.kept_districts(_counted(spark, sf)).select("code", "area_count", "total_count")


def a07_sido_list(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "housing_units").select("code", F.concat_ws(" ", "sido", F.concat(F.lit("구"), "code")).alias("region"))
    return A.sido_list(A.district_labels(units)).orderBy("sido")


def o03_dongs_by_count(spark: SparkSession, sf: str) -> DataFrame:
    stats = A.moments(_counted(spark, sf), ["code", "dong"])
    return stats.select("code", "dong", "count").orderBy("code", F.desc("count"), "dong")


def o04_districts_by_code(spark: SparkSession, sf: str) -> DataFrame:
    return A.kept_districts(_counted(spark, sf)).select("code", "area_count").orderBy("code")


def w01_rank_in_group(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    return pick_ranks(_counted(spark, sf), ["code"], "price", {"first": F.lit(0), "upper_median": F.floor(n / 2), "last": n - 1})


def w03_district_label(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "raw_price_rows")
    rows = A.clean_units(units)
    return A.district_labels(rows).withColumn("short", A.short_label(F.col("region")))


def j14_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    counted = _counted(spark, sf)
    areas = counted.groupBy("code", "dong").agg(F.sum("cnt").alias("count"))
    known = areas.where(F.col("dong") != "D3").select(
        "code", "dong", (F.col("code").cast("double") / 300).alias("lat"), (F.col("code").cast("double") / 90).alias("lon")
    )
    return A.with_coordinates(areas, known, ["code", "dong"]).select(
        "code", "dong", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")
    )


def k18_guarantee_limits(spark: SparkSession, sf: str) -> DataFrame:
    price, senior = F.col("price"), F.lit(50_000_000)
    return view(spark, sf, "housing_units").select(
        "l_orderkey",
        "l_linenumber",
        "price",
        G.limit_from_price(price).alias("limit_won"),
        G.max_deposit(price, senior).alias("max_deposit"),
        G.required_price(G.max_deposit(price, senior), senior).alias("required_price"),
    )


def k19_ratio_at_least(spark: SparkSession, sf: str) -> DataFrame:
    stats = A.moments(_counted(spark, sf), ["code", "dong"])
    limits = F.explode(F.array(*[F.lit(t).cast("bigint") for t in (0, 95_000_000, 158_730_159, 400_000_000, 505_000_000, 600_000_000)]))
    return stats.withColumn("threshold", limits).select(
        "code", "dong", "threshold", F.round(G.ratio_at_least(F.col("hist"), F.col("threshold")), 9).alias("ratio")
    )


def k20_grade(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "housing_units")
    share = F.when(F.col("l_linenumber") != 3, F.col("area") / 60)
    return units.groupBy(G.grade(share).alias("grade")).agg(F.count(F.lit(1)).alias("rows"))


def k21_area_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    scored = A.evaluate(A.dong_stats(_counted(spark, sf)), SCENARIOS)
    return scored.select(
        "code", "dong", "deposit", "senior", "count", "need", F.round("ratio", 9).alias("ratio"), "grade",
        "avg_max_deposit", "median_max_deposit",
    ).orderBy("deposit", "senior", F.desc("ratio"), "code", "dong")


def o05_areas_by_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Districts of one province, best share first (also the province filter P16)."""
    scored = A.evaluate(A.district_stats(_counted(spark, sf)).where("sido = '11'"), SCENARIOS[:1])
    return scored.where(F.col("ratio").isNotNull()).select("code", F.round("ratio", 9).alias("ratio"), "grade").orderBy(
        F.desc("ratio"), "code"
    )


def a23_grade_buckets(spark: SparkSession, sf: str) -> DataFrame:
    scored = A.evaluate(A.dong_stats(_counted(spark, sf)), SCENARIOS)
    return A.grade_buckets(scored, ["deposit", "senior"])


def p01_target_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "raw_price_rows").where(N.is_target_type(F.col("type")))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("rows"))


def p06_valid_units(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.clean_units(view(spark, sf, "raw_price_rows"))
    return rows.groupBy("code", "dong").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("price_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        a01_dong_stats, a02_index_percentiles, a03_price_histogram, a04_minimum_sample, a05_district_rollup, a06_total_count,
        a07_sido_list, o03_dongs_by_count, o04_districts_by_code, w01_rank_in_group, w03_district_label, j14_coordinates,
        k18_guarantee_limits, k19_ratio_at_least, k20_grade, k21_area_evaluation, o05_areas_by_ratio, a23_grade_buckets,
        p01_target_types, p06_valid_units,
    )
}

_U = "u AS (SELECT code, dong, price FROM housing_units WHERE type IN ('연립', '다세대') AND price > 0)"
_RANKED = f"""{_U}, r AS (SELECT code, dong, price, row_number() OVER (PARTITION BY code, dong ORDER BY price) - 1 AS k,
  count(*) OVER (PARTITION BY code, dong) AS n FROM u)"""
_STATS = f"""{_RANKED}, stats AS (SELECT code, dong, max(n) AS count, CAST(sum(price) // max(n) AS BIGINT) AS avg,
  CAST((max(price) FILTER (k = (n - 1) // 2) + max(price) FILTER (k = n // 2)) // 2 AS BIGINT) AS median,
  max(price) FILTER (k = n // 4) AS p25, max(price) FILTER (k = 3 * n // 4) AS p75, min(price) AS min, max(price) AS max
  FROM r GROUP BY code, dong)"""
_DISTRICT_RANKED = f"""{_U}, r AS (SELECT code, price, row_number() OVER (PARTITION BY code ORDER BY price) - 1 AS k,
  count(*) OVER (PARTITION BY code) AS n FROM u), d AS (SELECT code, max(n) AS count, CAST(sum(price) // max(n) AS BIGINT) AS avg,
  CAST((max(price) FILTER (k = (n - 1) // 2) + max(price) FILTER (k = n // 2)) // 2 AS BIGINT) AS median FROM r GROUP BY code),
  kd AS (SELECT code, count(*) AS area_count, CAST(sum(n) AS BIGINT) AS total_count FROM (SELECT code, dong, count(*) AS n FROM u GROUP BY code, dong)
  WHERE n >= 5 GROUP BY code)"""


def _hist(keys: str) -> str:
    return f"""h AS (SELECT {keys}, least(price // 10000000, 50) AS bin, count(*) AS c FROM u GROUP BY ALL),
  g AS (SELECT DISTINCT {keys} FROM h),
  dense AS (SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, b.bin, coalesce(h.c, 0) AS c
  FROM g CROSS JOIN (SELECT unnest(range(51)) AS bin) b LEFT JOIN h ON h.bin = b.bin AND {' AND '.join(f'h.{k.strip()} = g.{k.strip()}' for k in keys.split(','))})"""


_RATIO = """least(1.0::DOUBLE, greatest(0.0::DOUBLE, sum(CASE WHEN bin * 1e7 >= t THEN c::DOUBLE
  WHEN bin = 50 OR (bin + 1) * 1e7 > t THEN c::DOUBLE * ((bin + 1) * 1e7 - t) / 1e7 ELSE 0.0::DOUBLE END) / sum(c)))"""
_GRADE = "CASE WHEN ratio IS NULL THEN NULL WHEN ratio >= 0.7 THEN 'GOOD' WHEN ratio >= 0.3 THEN 'MID' ELSE 'HARD' END"
_LIMIT = "CAST(floor({p}::DOUBLE * 1.4::DOUBLE * 0.9::DOUBLE) AS BIGINT)"
_NEED = "CAST(ceil((d + s)::DOUBLE / (1.4::DOUBLE * 0.9::DOUBLE)) AS BIGINT)"
_SCENARIOS = "sc AS (SELECT d::BIGINT AS d, s::BIGINT AS s FROM (VALUES (200000000, 0), (200000000, 80000000), (450000000, 150000000)) v(d, s))"
_SCORED = f"""{_STATS}, {_hist('code, dong')}, {_SCENARIOS}, need AS (SELECT d, s, {_NEED} AS t FROM sc),
  ra AS (SELECT code, dong, d, s, t, {_RATIO} AS ratio FROM dense CROSS JOIN need GROUP BY code, dong, d, s, t),
  scored AS (SELECT st.code, st.dong, d AS deposit, s AS senior, count, t AS need, ratio, {_GRADE} AS grade,
  greatest(0, {_LIMIT.format(p='avg')} - s) AS avg_max_deposit, greatest(0, {_LIMIT.format(p='median')} - s) AS median_max_deposit
  FROM stats st JOIN ra ON st.code = ra.code AND st.dong = ra.dong WHERE count >= 5)"""
_CLEAN = r"""clean AS (SELECT substr(trim(ldcode), 1, 5) AS code, trim(eupmyeondong) AS dong, trim(sigungu) AS region,
  CAST(trunc(TRY_CAST(replace(price, ',', '') AS DOUBLE)) AS BIGINT) AS price FROM raw_price_rows
  WHERE regexp_matches(type, '연립|다세대') AND regexp_matches(replace(price, ',', ''), '^([0-9]+\.?[0-9]*|\.[0-9]+)$')
  AND TRY_CAST(replace(price, ',', '') AS DOUBLE) >= 1 AND regexp_matches(trim(ldcode), '^[0-9]{5}') AND trim(eupmyeondong) <> '')"""

ORACLES = {
    "a01_dong_stats": with_views(f"WITH {_STATS} SELECT code, dong, count, avg, median, min, max FROM stats WHERE count >= 5", "housing_units"),
    "a02_index_percentiles": with_views(f"WITH {_STATS} SELECT code, dong, count AS n, p25, p75 FROM stats WHERE count >= 5", "housing_units"),
    "a03_price_histogram": with_views(
        f"WITH {_U}, {_hist('code, dong')} SELECT code, dong, CAST(sum(c) AS BIGINT) AS count, string_agg(CAST(c AS VARCHAR), ',' ORDER BY bin) AS hist FROM dense GROUP BY code, dong",
        "housing_units",
    ),
    "a04_minimum_sample": with_views(
        """SELECT count(*) FILTER (n >= 5) AS kept_groups, count(*) FILTER (n < 5) AS dropped_groups,
        CAST(coalesce(sum(n) FILTER (n < 5), 0) AS BIGINT) AS dropped_rows
        FROM (SELECT count(*) AS n FROM housing_units GROUP BY code, dong, type, area)""",
        "housing_units",
    ),
    "a05_district_rollup": with_views(
        f"""WITH {_DISTRICT_RANKED}, {_hist('code')}, hj AS (SELECT code, string_agg(CAST(c AS VARCHAR), ',' ORDER BY bin) AS hist FROM dense GROUP BY code)
        SELECT d.code, substr(d.code, 1, 2) AS sido, area_count, count, avg, median, hist FROM d JOIN kd ON d.code = kd.code JOIN hj ON d.code = hj.code""",
        "housing_units",
    ),
    "a06_total_count": with_views(f"WITH {_DISTRICT_RANKED} SELECT code, area_count, total_count FROM kd", "housing_units"),
    "a07_sido_list": with_views(
        "SELECT substr(code, 1, 2) AS sido, arg_min(sido, code) AS name FROM housing_units GROUP BY 1 ORDER BY 1", "housing_units"
    ),
    "o03_dongs_by_count": with_views(
        f"WITH {_U} SELECT code, dong, count(*) AS count FROM u GROUP BY code, dong ORDER BY code, count DESC, dong", "housing_units"
    ),
    "o04_districts_by_code": with_views(f"WITH {_DISTRICT_RANKED} SELECT code, area_count FROM kd ORDER BY code", "housing_units"),
    "w01_rank_in_group": with_views(
        f"WITH {_DISTRICT_RANKED} SELECT code, max(n) AS n, min(price) AS first, max(price) FILTER (k = n // 2) AS upper_median, max(price) AS last FROM r GROUP BY code",
        "housing_units",
    ),
    "w03_district_label": with_views(
        f"WITH {_CLEAN} SELECT code, min(region) AS region, min(region) AS short FROM clean GROUP BY code", "raw_price_rows"
    ),
    "j14_coordinates": with_views(
        f"""WITH {_U} SELECT DISTINCT code, dong, CASE WHEN dong <> 'D3' THEN round(CAST(code AS DOUBLE) / 300, 4) END AS lat,
        CASE WHEN dong <> 'D3' THEN round(CAST(code AS DOUBLE) / 90, 4) END AS lon FROM u""",
        "housing_units",
    ),
    "k18_guarantee_limits": with_views(
        f"""SELECT l_orderkey, l_linenumber, price, {_LIMIT.format(p='price')} AS limit_won,
        greatest(0, {_LIMIT.format(p='price')} - 50000000) AS max_deposit,
        CASE WHEN {_LIMIT.format(p='price')} > 50000000 THEN CAST(ceil({_LIMIT.format(p='price')}::DOUBLE / (1.4::DOUBLE * 0.9::DOUBLE)) AS BIGINT) ELSE 0 END AS required_price
        FROM housing_units""",
        "housing_units",
    ),
    "k19_ratio_at_least": with_views(
        f"""WITH {_U}, {_hist('code, dong')}, th AS (SELECT unnest([0, 95000000, 158730159, 400000000, 505000000, 600000000])::BIGINT AS t)
        SELECT code, dong, t AS threshold, round({_RATIO}, 9) AS ratio FROM dense CROSS JOIN th GROUP BY code, dong, t""",
        "housing_units",
    ),
    "k20_grade": with_views(
        f"SELECT {_GRADE} AS grade, count(*) AS rows FROM (SELECT CASE WHEN l_linenumber <> 3 THEN area / 60 END AS ratio FROM housing_units) GROUP BY 1",
        "housing_units",
    ),
    "k21_area_evaluation": with_views(
        f"""WITH {_SCORED} SELECT code, dong, deposit, senior, count, need, round(ratio, 9) AS ratio, grade, avg_max_deposit, median_max_deposit
        FROM scored ORDER BY deposit, senior, ratio DESC, code, dong""",
        "housing_units",
    ),
    "o05_areas_by_ratio": with_views(
        f"""WITH {_U}, {_hist('code')}, ra AS (SELECT code, {_RATIO} AS ratio FROM dense CROSS JOIN (SELECT 158730159 AS t) GROUP BY code)
        SELECT code, round(ratio, 9) AS ratio, {_GRADE} AS grade FROM ra WHERE substr(code, 1, 2) = '11' ORDER BY ratio DESC, code""",
        "housing_units",
    ),
    "a23_grade_buckets": with_views(
        f"""WITH {_SCORED} SELECT deposit, senior, grade, count(*) AS areas,
        CAST(CASE grade WHEN 'GOOD' THEN 0 WHEN 'MID' THEN 1 ELSE 2 END AS INTEGER) AS grade_rank FROM scored GROUP BY deposit, senior, grade""",
        "housing_units",
    ),
    "p01_target_types": with_views(
        "SELECT type, count(*) AS rows FROM raw_price_rows WHERE regexp_matches(type, '연립|다세대') GROUP BY type", "raw_price_rows"
    ),
    "p06_valid_units": with_views(
        f"WITH {_CLEAN} SELECT code, dong, count(*) AS rows, CAST(sum(price) AS BIGINT) AS price_sum FROM clean GROUP BY code, dong",
        "raw_price_rows",
    ),
}

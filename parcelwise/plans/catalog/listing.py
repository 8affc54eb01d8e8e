"""Low-price listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import numbers as N
from ...operators import listing as L
from ...sources.views import view, with_views

LIMIT = 100_000_000
REGIONS = ("11000", "11010", "11020", "11130")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return L.listing_items(L.kept_rows(view(spark, sf, "raw_price_rows"), LIMIT))


def p02_normal_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "raw_price_rows")
    return rows.groupBy(N.normal_type(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("rows"))


def p03_number_parsing(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "raw_price_rows")
    return rows.groupBy(
        N.parse_price_signed(F.col("price")).alias("signed"),
        N.parse_price_plain(F.col("price")).alias("plain"),
        N.parse_area(F.col("area")).alias("area"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def p04_price_cap(spark: SparkSession, sf: str) -> DataFrame:
    kept = view(spark, sf, "housing_units").where(F.col("price") <= LIMIT)
    return kept.select("l_orderkey", "l_linenumber", "code", "price")


def p05_region_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.kept_rows(view(spark, sf, "raw_price_rows"), LIMIT, REGIONS)
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))


def p07_row_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return L.row_accounting(L.classify_rows(view(spark, sf, "raw_price_rows"), LIMIT, REGIONS))


def p09_district_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "raw_price_rows")
    return rows.groupBy(
        N.district_code(F.col("ldcode"), strict=True).alias("strict_code"),
        N.district_code(F.col("ldcode"), strict=False).alias("loose_code"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def p10_listing_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf)


def p14_browse(spark: SparkSession, sf: str) -> DataFrame:
    shown = L.browse(_items(spark, sf), "다세대", "middle")
    return shown.groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.min("price").alias("cheapest"))


def a08_district_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.district_index(_items(spark, sf), LIMIT).orderBy("code")


def a09_upper_median_per_m2(spark: SparkSession, sf: str) -> DataFrame:
    return L.upper_median_per_m2(_items(spark, sf), ["code"])


def o01_by_price(spark: SparkSession, sf: str) -> DataFrame:
    """First page (300 rows) of the listing of one district, cheapest first."""
    shown = _items(spark, sf).where("code = '11010'").select("price", "name", "bld_dong", "ho", "area")
    return L.by_price(shown, "name", "bld_dong", "ho", "area").limit(300)


def o02_by_price_per_m2(spark: SparkSession, sf: str) -> DataFrame:
    shown = _items(spark, sf).where("code = '11020'").select("per_m2", "name", "bld_dong", "ho", "price")
    return L.by_price_per_m2(shown, "name", "bld_dong", "ho", "price").limit(300)


def o07_page(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of the same listing."""
    shown = _items(spark, sf).where("code = '11010'").select("price", "name", "bld_dong", "ho", "area")
    return L.by_price(shown, "name", "bld_dong", "ho", "area").offset(50).limit(50)


QUERIES = {
    f.__name__: f
    for f in (
        p02_normal_type, p03_number_parsing, p04_price_cap, p05_region_filter, p07_row_accounting, p09_district_codes,
        p10_listing_items, p14_browse, a08_district_counts, a09_upper_median_per_m2, o01_by_price, o02_by_price_per_m2, o07_page,
    )
}

_SIGNED = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_PLAIN = r"'^([0-9]+\.?[0-9]*|\.[0-9]+)$'"
_STRIP = "trim(replace(replace({c}, ',', ''), '\"', ''))"
_PRICE = f"CASE WHEN regexp_matches({_STRIP.format(c='price')}, {_SIGNED}) THEN CAST(trunc(TRY_CAST({_STRIP.format(c='price')} AS DOUBLE)) AS BIGINT) END"
_AREA = f"CASE WHEN regexp_matches({_STRIP.format(c='area')}, {_SIGNED}) THEN TRY_CAST({_STRIP.format(c='area')} AS DOUBLE) END"
_TYPE = "CASE WHEN contains(type, '아파트') THEN '아파트' WHEN contains(type, '연립') THEN '연립' WHEN contains(type, '다세대') THEN '다세대' WHEN trim(type) = '' THEN '기타' ELSE trim(type) END"
_LOOSE = "CASE WHEN length(trim(ldcode)) >= 5 THEN substr(trim(ldcode), 1, 5) END"
_TYPED = f"t AS (SELECT * EXCLUDE (price, area, type, dong), dong AS bld_dong, {_PRICE} AS price, {_AREA} AS area, {_TYPE} AS type, {_LOOSE} AS code FROM raw_price_rows)"
_ITEMS = f"""{_TYPED}, items AS (SELECT code, concat(sido, ' ', sigungu) AS region, trim(eupmyeondong) AS dong, name, bld_dong, ho, type,
  round_even(area, 2) AS area, price, CAST(round_even(price / area, 0) AS BIGINT) AS per_m2
  FROM t WHERE price IS NOT NULL AND area > 0 AND price <= {LIMIT} AND code IS NOT NULL)"""
_IN = ", ".join(f"'{r}'" for r in REGIONS)

ORACLES = {
    "p02_normal_type": with_views(f"SELECT {_TYPE} AS type, count(*) AS rows FROM raw_price_rows GROUP BY 1", "raw_price_rows"),
    "p03_number_parsing": with_views(
        f"""SELECT {_PRICE} AS signed, CASE WHEN regexp_matches(replace(price, ',', ''), {_PLAIN})
        THEN CAST(trunc(TRY_CAST(replace(price, ',', '') AS DOUBLE)) AS BIGINT) END AS plain, {_AREA} AS area, count(*) AS rows
        FROM raw_price_rows GROUP BY ALL""",
        "raw_price_rows",
    ),
    "p04_price_cap": with_views(f"SELECT l_orderkey, l_linenumber, code, price FROM housing_units WHERE price <= {LIMIT}", "housing_units"),
    "p05_region_filter": with_views(
        f"WITH {_ITEMS} SELECT code, count(*) AS rows FROM items WHERE code IN ({_IN}) GROUP BY code", "raw_price_rows"
    ),
    "p07_row_accounting": with_views(
        f"""WITH {_TYPED} SELECT count(*) AS total,
        count(*) FILTER (price IS NOT NULL AND area > 0 AND price <= {LIMIT} AND code IN ({_IN})) AS kept,
        count(*) FILTER (price IS NULL OR area IS NULL OR area <= 0 OR (price <= {LIMIT} AND code IS NULL)) AS skipped FROM t""",
        "raw_price_rows",
    ),
    "p09_district_codes": with_views(
        f"""SELECT CASE WHEN regexp_matches(trim(ldcode), '^[0-9]{{5}}') THEN substr(trim(ldcode), 1, 5) END AS strict_code,
        {_LOOSE} AS loose_code, count(*) AS rows FROM raw_price_rows GROUP BY ALL""",
        "raw_price_rows",
    ),
    "p10_listing_items": with_views(f"WITH {_ITEMS} SELECT * FROM items", "raw_price_rows"),
    "p14_browse": with_views(
        f"WITH {_ITEMS} SELECT code, count(*) AS rows, min(price) AS cheapest FROM items WHERE type = '다세대' AND area >= 40 AND area < 60 GROUP BY code",
        "raw_price_rows",
    ),
    "a08_district_counts": with_views(
        f"WITH {_ITEMS} SELECT code, min(region) AS region, CAST({LIMIT} AS BIGINT) AS price_limit, count(*) AS item_count FROM items GROUP BY code ORDER BY code",
        "raw_price_rows",
    ),
    "a09_upper_median_per_m2": with_views(
        f"""WITH {_ITEMS}, r AS (SELECT code, per_m2, row_number() OVER (PARTITION BY code ORDER BY per_m2) - 1 AS k, count(*) OVER (PARTITION BY code) AS n FROM items WHERE per_m2 IS NOT NULL)
        SELECT code, n, per_m2 AS median_per_m2 FROM r WHERE k = n // 2""",
        "raw_price_rows",
    ),
    "o01_by_price": with_views(
        f"WITH {_ITEMS} SELECT price, name, bld_dong, ho, area FROM items WHERE code = '11010' ORDER BY price, name, bld_dong, ho, area LIMIT 300",
        "raw_price_rows",
    ),
    "o02_by_price_per_m2": with_views(
        f"WITH {_ITEMS} SELECT per_m2, name, bld_dong, ho, price FROM items WHERE code = '11020' ORDER BY per_m2 NULLS LAST, name, bld_dong, ho, price LIMIT 300",
        "raw_price_rows",
    ),
    "o07_page": with_views(
        f"WITH {_ITEMS} SELECT price, name, bld_dong, ho, area FROM items WHERE code = '11010' ORDER BY price, name, bld_dong, ho, area LIMIT 50 OFFSET 50",
        "raw_price_rows",
    ),
}

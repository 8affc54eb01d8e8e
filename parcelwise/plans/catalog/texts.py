"""Money texts, map codes, files and sinks, the request stream (K22-K24, S1-S5, S7, S11-S14, T1, P16, A7 index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import mapcode, money
from ...operators import areas as A
from ...operators import listing as L
from ...operators import officetel as O
from ...session import configure, scratch_path
from ...sources import price_csv, sinks
from ...sources.views import table, view, with_views
from ...streaming.lookup_stream import start_lookup_stream
from .. import lookup as P
from .listing import LIMIT, _ITEMS
from ..areas import build_areas
from .areas import _CLEAN, _DISTRICT_RANKED, _STATS, _U, _hist
from .lookup import _KNOWN


def k22_parse_money(spark: SparkSession, sf: str) -> DataFrame:
    """The unit price of every line written in five ways."""
    n = F.col("l_partkey")
    big, small = F.floor(n / 100) % 9 + 1, n % 9 + 1
    text = lambda *p: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in p])
    spelled = (
        F.when(F.col("l_linenumber") == 1, text(big, "억 ", small, "천")).when(F.col("l_linenumber") == 2, text(big, "억", small, "000만원"))
        .when(F.col("l_linenumber") == 3, text(big, ",", F.lit("000"), "만원")).when(F.col("l_linenumber") == 4, text(n))
        .when(F.col("l_linenumber") == 5, text(small, ".5천만")).otherwise("모름")
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money.parse_money(spelled).alias("won"))


def k23_format_money(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("l_linenumber") == 2, F.col("price") % 10000).when(F.col("l_linenumber") == 3, 0).otherwise(F.col("price"))
    units = view(spark, sf, "housing_units").withColumn("p", price)
    return units.select(
        "l_orderkey", "l_linenumber", "p", money.format_money(F.col("p")).alias("cut"), money.format_money_rounded(F.col("p")).alias("rounded"),
        money.format_won(F.col("p")).alias("won"),
    )


def k24_map_codes(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = 33 + F.col("l_partkey") / 1000, 125 + F.col("l_suppkey") / 100
    coded = table(spark, sf, "lineitem").select(lat.alias("lat"), lon.alias("lon")).distinct().withColumn("center", mapcode.map_center(F.col("lat"), F.col("lon")))
    back = mapcode.read_map_center(F.col("center"))
    return coded.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "center", F.round(back["lat"], 6).alias("lat_back"), F.round(back["lon"], 6).alias("lon_back"))


QUOTE = '"'
_CSV_NAMES = {"ldcode": "법정동코드", "sido": "시도", "sigungu": "시군구", "eupmyeondong": "읍면동", "name": "단지명", "dong": "동", "ho": "호 명", "type": "공동주택구분", "area": "전용면적(㎡)", "price": "공동주택가격"}


def _written_csv(spark: SparkSession, sf: str, encoding: str) -> str:
    configure(spark)
    rows = view(spark, sf, "raw_price_rows").select(*[F.col(c).alias(n) for c, n in _CSV_NAMES.items()])
    path = scratch_path(spark, "price-csv")
    rows.write.option("header", True).option("encoding", encoding).option("escape", QUOTE).csv(path)
    return path


def s01_price_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows as a cp949 file, read back with detected encoding, accounted and listed."""
    raw = price_csv.read_prices(spark, _written_csv(spark, sf, "MS949"))
    items = L.listing_items(L.kept_rows(raw, LIMIT))
    return items.groupBy("code", "region").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("price_sum"))


def s01_mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows as files of one folder: price and area swapped and other header names in half of them."""
    configure(spark)
    rows = view(spark, sf, "raw_price_rows")
    half = F.coalesce(F.col("type").contains("연립"), F.lit(False))
    path = scratch_path(spark, "price-csv")
    plain = rows.where(half).select(*[F.col(c).alias(n) for c, n in _CSV_NAMES.items()])
    turned = rows.where(~half).select(*[F.col(c).alias({"price": "공시가격", "area": "면적"}.get(c, n)) for c, n in reversed(_CSV_NAMES.items())])
    for part in (plain, turned):
        part.write.mode("append").option("header", True).option("escape", QUOTE).csv(path)
    raw = price_csv.read_prices(spark, path)
    items = L.listing_items(L.kept_rows(raw, LIMIT))
    return items.groupBy("code", "region").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("price_sum"))


def s01_quoted_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows with a line break inside every name; rows, breaks and undecoded texts counted after reading."""
    configure(spark)
    rows = view(spark, sf, "raw_price_rows").withColumn("name", F.concat(F.coalesce("name", F.lit("")), F.lit("\n\"가\""), F.coalesce("ho", F.lit(""))))
    path = scratch_path(spark, "price-csv")
    rows.select(*[F.col(c).alias(n) for c, n in _CSV_NAMES.items()]).write.option("header", True).option("encoding", "MS949").option("escape", QUOTE).csv(path)
    raw = price_csv.read_prices(spark, path)
    return raw.groupBy(F.nullif(F.trim("type"), F.lit("")).alias("type")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("name").contains("\n\"가\"")).alias("breaks"), F.count_if("_short").alias("short"), price_csv.undecoded(raw).alias("undecoded")
    )


def s05_multi_member(spark: SparkSession, sf: str) -> DataFrame:
    """Two members: a comma file with all columns and a tab file without a code column."""
    configure(spark)
    rows = view(spark, sf, "raw_price_rows")
    first, second = scratch_path(spark, "member"), scratch_path(spark, "member")
    rows.where("type LIKE '%연립%'").select(
        F.col("type").alias("공동주택구분명"), F.col("area").alias("전용 면적"), F.col("price").alias("공시가격"), F.col("sido").alias("시도"), F.col("eupmyeondong").alias("법정동명"), F.col("ldcode").alias("법정동코드")
    ).write.option("header", True).option("escape", QUOTE).csv(first)
    rows.where("NOT type LIKE '%연립%'").select(
        F.col("type").alias("주택유형"), F.col("area").alias("전용면적"), F.col("price").alias("공동주택 가격"), F.col("eupmyeondong").alias("법정동")
    ).write.option("header", True).option("sep", "\t").option("escape", QUOTE).csv(second)
    members = price_csv.read_members(spark, [first, second])
    return members.groupBy("sido", F.trim("housing_type").alias("housing_type")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("dong_code") == "").alias("without_code"))


_ITEM_SCHEMA = "region string, dong string, name string, bld_dong string, ho string, type string, area double, price bigint, per_m2 bigint"


def s11_district_items(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "listing")
    sinks.write_district_items(L.listing_items(L.kept_rows(view(spark, sf, "raw_price_rows"), LIMIT)), path, "price")
    return spark.read.schema(f"{_ITEM_SCHEMA}, code string").json(path).groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.min("price").alias("cheapest"))


def s14_read_back(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "listing")
    sinks.write_district_items(L.listing_items(L.kept_rows(view(spark, sf, "raw_price_rows"), LIMIT)), path, "price")
    return sinks.read_district(spark, path, "11030", _ITEM_SCHEMA).select("code", "name", "bld_dong", "ho", "price")


def _area_job(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The area job over the raw rows, with coordinates for most neighbourhoods and every second district."""
    raw = view(spark, sf, "raw_price_rows").withColumn("sigungu", F.concat_ws(" ", "sido", "sigungu"))
    code = F.substring("ldcode", 1, 5)
    known = raw.select(code.alias("code"), F.col("eupmyeondong").alias("dong")).where("dong <> 'D3'").distinct()
    known = known.unionByName(known.where("try_cast(code AS INT) % 20 = 0").select("code", F.lit(None).cast("string").alias("dong")))
    known = known.select("code", "dong", (F.col("code").try_cast("double") / 300).alias("lat"), (F.col("code").try_cast("double") / 90).alias("lon"))
    path = scratch_path(spark, "areas")
    return path, build_areas(raw, path, 2026, known)


_AREA_ROW = "code string, count bigint, avg bigint, median bigint, hist array<bigint>, lat double, lon double"


def _written(spark: SparkSession, path: str, more: str) -> DataFrame:
    rows = spark.read.schema(f"{_AREA_ROW}, {more}").json(path)
    return rows.withColumns({"hist": F.array_join(F.col("hist").cast("array<string>"), ","), "lat": F.round("lat", 4), "lon": F.round("lon", 4)})


def s12_area_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbourhood rows as written."""
    path, _ = _area_job(spark, sf)
    return _written(spark, f"{path}/areas", "dong string, p25 bigint, p75 bigint, min bigint, max bigint")


def s13_area_index(spark: SparkSession, sf: str) -> DataFrame:
    """The district index as written."""
    path, _ = _area_job(spark, sf)
    more = "sido string, region string, short string, area_count bigint, total_count bigint, price_year int, bin_size bigint, bin_max bigint, types array<string>"
    return _written(spark, f"{path}/index", more).withColumn("types", F.array_join("types", ","))


def s13_area_provinces(spark: SparkSession, sf: str) -> DataFrame:
    """The province list as written."""
    path, _ = _area_job(spark, sf)
    return spark.read.schema("sido string, name string").json(f"{path}/sido")


def p07_stats_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Rows read, kept and rejected by reason."""
    return A.accounting(view(spark, sf, "raw_price_rows"))


def s13_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    sinks.write_index(L.district_index(L.listing_items(L.kept_rows(view(spark, sf, "raw_price_rows"), LIMIT)), LIMIT), path)
    return spark.read.schema("code string, region string, price_limit bigint, item_count bigint").json(path)


def s07_upsert_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads merged into a stored table partitioned by year."""
    path = scratch_path(spark, "officetel")
    office = view(spark, sf, "officetel").select(*O.COLUMNS)
    sinks.upsert_officetel(spark, path, office)
    sinks.upsert_officetel(spark, path, office.where("CAST(ho AS INT) % 2 = 1 AND year = '2026'").withColumn("price", F.col("price") + 7))
    return spark.read.parquet(path).groupBy(F.col("year").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price") % 20 == 7).alias("odd_prices"))


def t01_request_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Requests written as files, streamed through the lookup, answers read back."""
    inbox, answers, checkpoint = (scratch_path(spark, n) for n in ("inbox", "answers", "stream"))
    requests = view(spark, sf, "requests").select("request_id", F.lit("서울 물결구 누리동 1").alias("q"), "dong", "ho", "pnu")
    requests.write.json(inbox)
    sources = P.Sources(view(spark, sf, "unit_price"), view(spark, sf, "officetel"), view(spark, sf, "primary_candidates"), view(spark, sf, "secondary_candidates"))
    start_lookup_stream(spark, inbox, answers, checkpoint, sources, "2026", "2025").awaitTermination()
    return spark.read.parquet(answers).select("request_id", "price_this", "price_last", "needs_unit")


QUERIES = {
    f.__name__: f
    for f in (
        k22_parse_money, k23_format_money, k24_map_codes, s01_price_csv_scan, s01_mixed_headers, s01_quoted_breaks, s05_multi_member, s11_district_items, s12_area_payload, s13_index, s14_read_back,
        s13_area_index, s13_area_provinces, p07_stats_accounting,
        s07_upsert_table, t01_request_stream,
    )
}

_SPELLED = "(l_partkey // 100 % 9 + 1)"
_ALPHABET = "'0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _code(v: str) -> str:
    digits = ", ".join(f"substr({_ALPHABET}, CAST((n_{v} // {62**p}) % 62 + 1 AS INTEGER), 1)" for p in range(5, -1, -1))
    return f"concat({digits})"


_RAW_UNITS = _CLEAN.replace("trim(sigungu)", "concat(sido, ' ', sigungu)") + ", u AS (SELECT code, dong, price FROM clean)"
_RAW_STATS = _STATS.replace(_U, _RAW_UNITS)
_RAW_INDEX = _DISTRICT_RANKED.replace(_U, _RAW_UNITS) + ", names AS (SELECT code, min(region) AS region FROM clean GROUP BY code)"
_COORDINATES = "CASE WHEN {known} THEN round(CAST(s.code AS DOUBLE) / 300, 4) END AS lat, CASE WHEN {known} THEN round(CAST(s.code AS DOUBLE) / 90, 4) END AS lon"

ORACLES = {
    "k22_parse_money": f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE l_linenumber WHEN 1 THEN {_SPELLED} * 100000000 + (l_partkey % 9 + 1) * 10000000
        WHEN 2 THEN {_SPELLED} * 100000000 + (l_partkey % 9 + 1) * 10000000 WHEN 3 THEN {_SPELLED} * 10000000 WHEN 4 THEN l_partkey WHEN 5 THEN (l_partkey % 9 + 1) * 10000000 + 5000000 END AS BIGINT) AS won FROM lineitem""",
    "k23_format_money": with_views(
        """WITH u AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 2 THEN price % 10000 WHEN 3 THEN 0 ELSE price END AS p FROM housing_units),
        v AS (SELECT *, p // 100000000 AS e, (p % 100000000) // 10000 AS m, ((p % 100000000) + 5000) // 10000 AS mr FROM u)
        SELECT l_orderkey, l_linenumber, p, CASE WHEN p = 0 THEN '0원' WHEN e = 0 AND m = 0 THEN concat(format('{:,}', p), '원')
        ELSE concat(concat_ws(' ', CASE WHEN e > 0 THEN concat(e, '억') END, CASE WHEN m > 0 THEN concat(format('{:,}', m), '만') END), '원') END AS cut,
        concat(CASE WHEN e = 0 AND mr = 0 THEN '0' ELSE concat_ws(' ', CASE WHEN e > 0 THEN concat(e, '억') END, CASE WHEN mr > 0 THEN concat(format('{:,}', mr), '만') END) END, '원') AS rounded,
        concat(format('{:,}', p), '원') AS won FROM v""",
        "housing_units",
    ),
    "k24_map_codes": f"""WITH c AS (SELECT DISTINCT 33 + l_partkey / 1000 AS lat, 125 + l_suppkey / 100 AS lon FROM lineitem),
        n AS (SELECT *, CAST(floor(lat * 1e7 + 0.5) AS BIGINT) + 2000000000 AS n_lat, CAST(floor(lon * 1e7 + 0.5) AS BIGINT) + 2000000000 AS n_lon FROM c)
        SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, concat({_code('lon')}, '-', {_code('lat')}) AS center, round(lat, 6) AS lat_back, round(lon, 6) AS lon_back FROM n""",
    "s01_price_csv_scan": with_views(
        f"WITH {_ITEMS} SELECT code, region, count(*) AS rows, CAST(sum(price) AS BIGINT) AS price_sum FROM items GROUP BY code, region", "raw_price_rows"
    ),
    "s01_mixed_headers": with_views(
        f"WITH {_ITEMS} SELECT code, region, count(*) AS rows, CAST(sum(price) AS BIGINT) AS price_sum FROM items GROUP BY code, region", "raw_price_rows"
    ),
    "s01_quoted_breaks": with_views(
        "SELECT nullif(trim(type), '') AS type, count(*) AS rows, count(*) AS breaks, CAST(0 AS BIGINT) AS short, CAST(0 AS BIGINT) AS undecoded FROM raw_price_rows GROUP BY 1", "raw_price_rows"
    ),
    "s05_multi_member": with_views(
        """SELECT CASE WHEN type LIKE '%연립%' THEN sido ELSE '' END AS sido, nullif(trim(type), '') AS housing_type, count(*) AS rows, count(*) FILTER (NOT type LIKE '%연립%') AS without_code FROM raw_price_rows GROUP BY ALL""",
        "raw_price_rows",
    ),
    "s11_district_items": with_views(f"WITH {_ITEMS} SELECT code, count(*) AS rows, min(price) AS cheapest FROM items GROUP BY code", "raw_price_rows"),
    "s14_read_back": with_views(f"WITH {_ITEMS} SELECT code, name, bld_dong, ho, price FROM items WHERE code = '11030'", "raw_price_rows"),
    "s12_area_payload": with_views(
        f"""WITH {_RAW_STATS}, {_hist('code, dong')}, hj AS (SELECT code, dong, string_agg(CAST(c AS VARCHAR), ',' ORDER BY bin) AS hist FROM dense GROUP BY ALL)
        SELECT s.code, s.dong, count, avg, median, hist, {_COORDINATES.format(known="s.dong <> 'D3'")}, p25, p75, min, max
        FROM stats s JOIN hj ON hj.code = s.code AND hj.dong = s.dong WHERE count >= 5""",
        "raw_price_rows",
    ),
    "s13_area_index": with_views(
        f"""WITH {_RAW_INDEX}, {_hist('code')}, hj AS (SELECT code, string_agg(CAST(c AS VARCHAR), ',' ORDER BY bin) AS hist FROM dense GROUP BY code)
        SELECT s.code, count, avg, median, hist, {_COORDINATES.format(known="CAST(s.code AS INTEGER) % 20 = 0")}, substr(s.code, 1, 2) AS sido, region, string_split(region, ' ')[-1] AS short,
        area_count, total_count, CAST(2026 AS INTEGER) AS price_year, CAST(10000000 AS BIGINT) AS bin_size, CAST(500000000 AS BIGINT) AS bin_max, '연립,다세대' AS types
        FROM d s JOIN kd ON kd.code = s.code JOIN hj ON hj.code = s.code JOIN names ON names.code = s.code""",
        "raw_price_rows",
    ),
    "s13_area_provinces": with_views(
        f"""WITH {_RAW_INDEX} SELECT substr(names.code, 1, 2) AS sido, string_split(arg_min(region, names.code), ' ')[1] AS name FROM names JOIN kd ON kd.code = names.code GROUP BY 1""",
        "raw_price_rows",
    ),
    "p07_stats_accounting": with_views(
        r"""WITH r AS (SELECT CASE WHEN NOT regexp_matches(coalesce(type, ''), '연립|다세대') THEN 'type'
        WHEN NOT regexp_matches(replace(price, ',', ''), '^([0-9]+\.?[0-9]*|\.[0-9]+)$') OR TRY_CAST(replace(price, ',', '') AS DOUBLE) < 1 THEN 'price'
        WHEN NOT regexp_matches(trim(ldcode), '^[0-9]{5}') THEN 'code' WHEN trim(eupmyeondong) = '' THEN 'dong' ELSE 'kept' END AS r FROM raw_price_rows)
        SELECT count(*) AS total, count(*) FILTER (r = 'kept') AS kept, count(*) FILTER (r <> 'kept') AS skipped, count(*) FILTER (r = 'type') AS bad_type,
        count(*) FILTER (r = 'price') AS bad_price, count(*) FILTER (r = 'code') AS bad_code, count(*) FILTER (r = 'dong') AS bad_dong FROM r""",
        "raw_price_rows",
    ),
    "s07_upsert_table": with_views(
        """WITH loads AS (SELECT *, 1 AS seq FROM officetel UNION ALL SELECT * REPLACE (price + 7 AS price), 2 AS seq FROM officetel WHERE CAST(ho AS INTEGER) % 2 = 1 AND year = '2026')
        SELECT year, count(*) AS rows, count(*) FILTER (price % 20 = 7) AS odd_prices FROM (SELECT *, row_number() OVER (PARTITION BY pnu, building, dong, floor, ho, year
        ORDER BY seq DESC, prvuse DESC, share DESC NULLS LAST, price DESC) AS rn FROM loads) WHERE rn = 1 GROUP BY year""",
        "officetel",
    ),
    "t01_request_stream": with_views(
        "WITH " + _KNOWN.replace("{units}", "SELECT * FROM unit_price") + """
        SELECT request_id, price_this, p_last AS price_last, src LIKE '%_choice' AS needs_unit FROM g""",
        "unit_price", "requests", "officetel",
    ),
    "s13_index": with_views(
        f"WITH {_ITEMS} SELECT code, min(region) AS region, CAST({LIMIT} AS BIGINT) AS price_limit, count(*) AS item_count FROM items GROUP BY code", "raw_price_rows"
    ),
}


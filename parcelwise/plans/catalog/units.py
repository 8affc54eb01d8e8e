"""Unit matching, parcel keys and office units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import keys as K
from ...operators import officetel as O
from ...operators import units as U
from ...session import stored
from ...sources import officetel_sheets
from ...sources.views import table, view, with_views

THIS_YEAR, LAST_YEAR = "2026", "2025"


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return U.match_units(view(spark, sf, "requests"), view(spark, sf, "unit_price"), THIS_YEAR)


def j01_raw_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).where("tier = 1").select("request_id", "total", "unit.dong", "unit.ho", "price")


def j02_normalised_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).where("tier = 2 AND candidates = 1").select("request_id", "unit.dong", "unit.ho", "price")


def j03_ho_only_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).where("tier = 3").select("request_id", "candidates", "price", "needs_unit")


def j04_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select("request_id", "total", "candidates", F.coalesce("tier", F.lit(0)).alias("tier"), "price", "needs_unit")


def j05_officetel_match(spark: SparkSession, sf: str) -> DataFrame:
    found = O.match_officetel(view(spark, sf, "requests"), view(spark, sf, "officetel"), THIS_YEAR)
    return found.select("request_id", "total", "is_matched", "needs_unit", "price")


def j06_two_year_match(spark: SparkSession, sf: str) -> DataFrame:
    both = U.attach_last_year(_matched(spark, sf), view(spark, sf, "unit_price"), LAST_YEAR)
    return both.select(
        "request_id", "price", "price_last", (F.col("price") - F.col("price_last")).alias("delta"),
        F.array_join("warnings_last", " / ").alias("notes"),
    )


def j06_officetel_two_years(spark: SparkSession, sf: str) -> DataFrame:
    office = view(spark, sf, "officetel")
    both = O.attach_last_year(O.match_officetel(view(spark, sf, "requests"), office, THIS_YEAR), office, LAST_YEAR)
    return both.select("request_id", "price", "price_last")


def j08_not_found(spark: SparkSession, sf: str) -> DataFrame:
    matched = stored(_matched(spark, sf).where("candidates = 0"), "unmatched")
    explained = U.explain_missing(matched, view(spark, sf, "unit_price"), THIS_YEAR)
    return explained.select("request_id", F.array_join("warnings", " / ").alias("reasons"))


def j09_elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "unit_price").withColumns({"dong": K.unit_token(F.col("dong")), "ho": K.unit_token(F.col("ho"))})
    requests = view(spark, sf, "requests")
    matched = stored(U.match_units(requests, units, THIS_YEAR).where("candidates = 0"), "unmatched")
    found = U.suggest_elsewhere(matched, units, THIS_YEAR)
    return found.select("request_id", "elsewhere_count", F.array_join("elsewhere_list", ",").alias("dongs"))


def a22_available_units(spark: SparkSession, sf: str) -> DataFrame:
    open_requests = stored(_matched(spark, sf).where("needs_unit"), "open-requests")
    listed = U.available_units(open_requests, view(spark, sf, "unit_price"), THIS_YEAR)
    return listed.orderBy("pnu", *K.natural_order(F.col("dong"), F.col("ho")))


def o06_natural_order(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "unit_price").select("dong", "ho").distinct()
    return units.select(
        "dong", "ho", K.first_number(F.col("dong")).cast("bigint").alias("dong_number"), K.first_number(F.col("ho")).cast("bigint").alias("ho_number")
    ).orderBy(*K.natural_order(F.col("dong"), F.col("ho")))


def p15_unit_browse(spark: SparkSession, sf: str) -> DataFrame:
    """Requests cut to two characters of building and one of the unit, as while typing."""
    units = view(spark, sf, "unit_price").withColumns({"dong": K.unit_token(F.col("dong")), "ho": K.unit_token(F.col("ho"))})
    typed = view(spark, sf, "requests").withColumns(
        {"dong": F.when(F.col("request_id") % 2 == 0, F.substring("dong", 1, 2)).otherwise(F.col("dong")), "ho": F.substring("ho", 1, 1)}
    )
    return U.browse_units(typed, units, THIS_YEAR)


def u04_distinct_units(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "unit_price").where(F.col("year") == THIS_YEAR)
    return units.select("pnu", "dong", "ho").distinct().groupBy("pnu").agg(F.count(F.lit(1)).alias("labels"))


def _lots(spark: SparkSession, sf: str) -> DataFrame:
    """Parcel parts with every kind of defect, from the order lines."""
    rows = table(spark, sf, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 29 == 0, "123").otherwise((F.col("l_suppkey") + 1100000000).cast("string")).alias("code"),
        F.when(F.col("l_partkey") % 31 == 0, "12a").when(F.col("l_partkey") % 37 == 0, "12345").otherwise((F.col("l_partkey") % 2000).cast("string")).alias("main_lot"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise((F.col("l_orderkey") % 50).cast("string")).alias("sub_lot"),
        F.when(F.col("l_returnflag") == "A", "1").otherwise("0").alias("mountain"),
    )


def k01_build_pnu(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return _lots(spark, sf).select(
        "l_orderkey", "l_linenumber", K.build_pnu(c("code"), c("main_lot"), c("sub_lot"), c("mountain")).alias("pnu"),
        K.pnu_problem(c("code"), c("main_lot"), c("sub_lot")).alias("problem"),
    )


def k02_mountain_flags(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 1, "1").when(F.col("l_linenumber") == 2, "y").when(F.col("l_linenumber") == 3, "산12").when(
        F.col("l_linenumber") == 4, "2").when(F.col("l_linenumber") == 5, F.lit(None)).otherwise("0")
    rows = table(spark, sf, "lineitem").select(value.alias("value"))
    return rows.groupBy(
        "value", *[K.mountain_flag(F.col("value"), s).alias(s) for s in ("juso", "kakao", "pnu")]
    ).agg(F.count(F.lit(1)).alias("rows"))


def k03_pad_lot(spark: SparkSession, sf: str) -> DataFrame:
    return _lots(spark, sf).groupBy(K.pad4(F.col("main_lot")).alias("main_lot")).agg(F.count(F.lit(1)).alias("rows"))


def k04_split_pnu(spark: SparkSession, sf: str) -> DataFrame:
    parcels = view(spark, sf, "unit_price").select("pnu").distinct()
    return parcels.select("pnu", K.split_pnu(F.col("pnu")).alias("p")).select("pnu", "p.code", "p.flag", "p.main_lot", "p.sub_lot")


def k05_unit_tokens(spark: SparkSession, sf: str) -> DataFrame:
    labels = view(spark, sf, "unit_price").select(F.explode(F.array("dong", F.concat(F.lit("B"), "ho"), "ho")).alias("label"))
    return labels.groupBy("label", K.unit_token(F.col("label")).alias("token")).agg(F.count(F.lit(1)).alias("rows"))


def k06_unit_keys(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "unit_price")
    return units.groupBy("pnu", "year", K.unit_key(F.col("dong"), F.col("floor"), F.col("ho")).alias("unit_key")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def k07_register_numbers(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.lpad(F.col("o_orderkey").cast("string"), 14, "7")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, digits)
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4), F.lit("-"), F.substring(digits, 9, 6)))
        .otherwise(F.concat(F.lit("누리동 "), F.col("o_orderkey").cast("string")))
    )
    return table(spark, sf, "orders").select("o_orderkey", K.register_number(text).alias("register_number"))


def k17_officetel_totals(spark: SparkSession, sf: str) -> DataFrame:
    office = view(spark, sf, "officetel")
    return office.select(
        "pnu", "floor", "ho", "year", "price", "prvuse",
        O.total_price(F.col("price"), F.col("prvuse"), F.col("share")).alias("total_price"),
        O.calc_area(F.col("prvuse"), F.col("share")).alias("total_area"),
    )


def s06_officetel_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Two exported sheets with positional columns, unioned, filtered and keyed."""
    sheets = officetel_sheets.sheets_from_lines(table(spark, sf, "lineitem"))
    loaded = officetel_sheets.ingest(sheets, THIS_YEAR, prefixes=["110000000", "110000001", "110000004"])
    return loaded.rows.select("pnu", "ldcode", "building", "dong", "floor", "ho", "prvuse", "share", "price", "year")


def s06_ingest_skipped(spark: SparkSession, sf: str) -> DataFrame:
    sheets = officetel_sheets.sheets_from_lines(table(spark, sf, "lineitem"))
    return officetel_sheets.ingest(sheets, THIS_YEAR).accounting


def _loads(spark: SparkSession, sf: str) -> DataFrame:
    office = view(spark, sf, "officetel")
    second = office.where("CAST(ho AS INT) % 2 = 1").withColumn("price", F.col("price") + 7)
    return office.withColumn("load_seq", F.lit(1)).unionByName(second.withColumn("load_seq", F.lit(2)))


def s07_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return O.latest_per_key(_loads(spark, sf)).select("pnu", "floor", "ho", "year", "price", "prvuse")


def w09_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    newest = O.latest_per_key(_loads(spark, sf))
    return newest.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("price_sum"))


def s16_load_report(spark: SparkSession, sf: str) -> DataFrame:
    return O.load_report(O.latest_per_key(_loads(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        j01_raw_match, j02_normalised_match, j03_ho_only_match, j04_resolution, j05_officetel_match, j06_two_year_match,
        j06_officetel_two_years, j08_not_found, j09_elsewhere, a22_available_units, o06_natural_order, p15_unit_browse,
        u04_distinct_units, k01_build_pnu, k02_mountain_flags, k03_pad_lot, k04_split_pnu, k05_unit_tokens, k06_unit_keys,
        k07_register_numbers, k17_officetel_totals, s06_officetel_ingest, s06_ingest_skipped, s07_upsert_latest,
        w09_latest_version, s16_load_report,
    )
}


def token(column: str) -> str:
    """Oracle text of a unit token (no look-around, so RE2 takes it)."""
    return (
        f"lower(regexp_replace(regexp_replace(regexp_replace(replace(trim(coalesce({column}, '')), ' ', ''), '^제+', ''), '[호동층]+$', ''), "
        r"'(^|[^0-9])0+([0-9])', '\1\2', 'g'))"
    )


# Tier counts of every request by plain joins; small data only.
MATCHED = f"""
 un AS (SELECT *, {token('dong')} AS nd, {token('ho')} AS nh, {token('floor')} AS nf FROM unit_price),
 cu AS (SELECT * FROM un WHERE year = '2026'),
 rq AS (SELECT *, {token('dong')} AS qd, {token('ho')} AS qh FROM requests),
 par AS (SELECT pnu, count(*) AS total, max(nd <> '') AS any_dong, min(price) AS only_price, min(dong) AS only_dong, min(ho) AS only_ho,
         min(floor) AS only_floor FROM cu GROUP BY pnu),
 raw AS (SELECT r.request_id, count(*) AS c, min(u.price) AS price, min(u.dong) AS udong, min(u.ho) AS uho, min(u.floor) AS ufloor FROM rq r JOIN cu u ON u.pnu = r.pnu
         AND (r.dong = '' OR u.dong = r.dong) AND (r.ho = '' OR u.ho = r.ho) WHERE r.dong <> '' OR r.ho <> '' GROUP BY r.request_id),
 nor AS (SELECT r.request_id, count(*) AS c, min(u.price) AS price, min(u.dong) AS udong, min(u.ho) AS uho, min(u.floor) AS ufloor FROM rq r JOIN cu u ON u.pnu = r.pnu
         AND (r.dong = '' OR u.nd = r.qd) AND (r.ho = '' OR u.nh = r.qh) WHERE r.dong <> '' OR r.ho <> '' GROUP BY r.request_id),
 hos AS (SELECT r.request_id, count(*) AS c, min(u.price) AS price, min(u.dong) AS udong, min(u.ho) AS uho, min(u.floor) AS ufloor FROM rq r JOIN cu u ON u.pnu = r.pnu
         AND u.nh = r.qh WHERE r.ho <> '' GROUP BY r.request_id),
 m0 AS (SELECT r.*, coalesce(par.total, 0) AS total, only_price, only_dong, only_ho, only_floor, raw.price AS p1, nor.price AS p2, hos.price AS p3,
         raw.udong AS d1, nor.udong AS d2, hos.udong AS d3, raw.uho AS h1, nor.uho AS h2, hos.uho AS h3, raw.ufloor AS f1, nor.ufloor AS f2, hos.ufloor AS f3,
         CASE WHEN raw.c = 1 THEN 1 WHEN nor.c > 0 THEN 2 WHEN hos.c > 0 AND r.dong <> '' AND NOT par.any_dong THEN 3 ELSE 0 END AS tier,
         CASE WHEN raw.c = 1 THEN 1 WHEN nor.c > 0 THEN nor.c WHEN hos.c > 0 AND r.dong <> '' AND NOT par.any_dong THEN hos.c ELSE 0 END AS candidates
         FROM rq r LEFT JOIN par ON par.pnu = r.pnu LEFT JOIN raw ON raw.request_id = r.request_id LEFT JOIN nor ON nor.request_id = r.request_id
         LEFT JOIN hos ON hos.request_id = r.request_id),
 m AS (SELECT *, CASE WHEN candidates = 1 THEN CASE tier WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END WHEN candidates = 0 AND total = 1 THEN only_price END AS price,
         CASE WHEN candidates = 1 THEN CASE tier WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END WHEN candidates = 0 AND total = 1 THEN only_dong END AS udong,
         CASE WHEN candidates = 1 THEN CASE tier WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END WHEN candidates = 0 AND total = 1 THEN only_ho END AS uho,
         CASE WHEN candidates = 1 THEN CASE tier WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END WHEN candidates = 0 AND total = 1 THEN only_floor END AS ufloor,
         total > 0 AND NOT (candidates = 1 OR (candidates = 0 AND total = 1)) AS needs_unit FROM m0)"""

_KEY = f"concat_ws('|', {token('udong')}, {token('ufloor')}, {token('uho')})"
_TWO_YEARS = f"""{MATCHED},
 lk AS (SELECT pnu, concat_ws('|', nd, nf, nh) AS k, count(*) AS c, min(price) AS price FROM un WHERE year = '2025' GROUP BY pnu, k),
 lp AS (SELECT pnu, count(*) AS total_last FROM un WHERE year = '2025' GROUP BY pnu),
 two AS (SELECT m.*, CASE WHEN lk.c = 1 THEN lk.price END AS price_last, coalesce(lk.c, 0) AS same, coalesce(total_last, 0) AS total_last
  FROM m LEFT JOIN lk ON lk.pnu = m.pnu AND m.price IS NOT NULL AND lk.k = {_KEY} LEFT JOIN lp ON lp.pnu = m.pnu)"""
_LOTS = """lots AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 29 = 0 THEN '123' ELSE CAST(l_suppkey + 1100000000 AS VARCHAR) END AS code,
 CASE WHEN l_partkey % 31 = 0 THEN '12a' WHEN l_partkey % 37 = 0 THEN '12345' ELSE CAST(l_partkey % 2000 AS VARCHAR) END AS main_lot,
 CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_orderkey % 50 AS VARCHAR) END AS sub_lot,
 CASE WHEN l_returnflag = 'A' THEN '2' ELSE '1' END AS flag FROM lineitem)"""
_TOTAL = "CAST(round_even(price::DOUBLE * (prvuse + coalesce(share, 0.0::DOUBLE)), 0) AS BIGINT)"
_SHEETS = """sh AS (SELECT CASE WHEN l_linenumber % 4 = 0 THEN '상가' ELSE '오피스텔' END AS kind, CAST(1100000000 + l_suppkey AS VARCHAR) AS ldcode,
 CASE WHEN l_returnflag = 'A' THEN '산' ELSE '일반' END AS special, CASE WHEN l_orderkey % 17 = 0 THEN 'x1' ELSE CAST(l_partkey % 100 AS VARCHAR) END AS lot,
 CAST(l_linenumber AS VARCHAR) AS sub, 'tower' AS building, CASE WHEN l_linenumber = 3 THEN '' ELSE '1' END AS dong,
 CAST(1 + l_orderkey % 9 AS VARCHAR) AS floor, CAST(100 * (1 + l_orderkey % 9) + l_orderkey % 4 AS VARCHAR) AS ho,
 CAST(floor(l_extendedprice * 20) AS BIGINT) AS price, l_quantity AS prvuse, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 2 END AS share
 FROM lineitem)"""

ORACLES = {
    "j01_raw_match": with_views(f"WITH {MATCHED} SELECT request_id, total, udong AS dong, uho AS ho, price FROM m WHERE tier = 1", "unit_price", "requests"),
    "j02_normalised_match": with_views(
        f"WITH {MATCHED} SELECT request_id, udong AS dong, uho AS ho, price FROM m WHERE tier = 2 AND candidates = 1", "unit_price", "requests"
    ),
    "j03_ho_only_match": with_views(f"WITH {MATCHED} SELECT request_id, candidates, price, needs_unit FROM m WHERE tier = 3", "unit_price", "requests"),
    "j04_resolution": with_views(
        f"WITH {MATCHED} SELECT request_id, total, candidates, CAST(tier AS INTEGER) AS tier, price, needs_unit FROM m", "unit_price", "requests"
    ),
    "j05_officetel_match": with_views(
        f"""WITH o AS (SELECT *, {token('ho')} AS nh, {_TOTAL} AS t FROM officetel WHERE year = '2026'),
        par AS (SELECT pnu, count(*) AS total, min(t) AS only_t FROM o GROUP BY pnu),
        hit AS (SELECT pnu, nh, t FROM (SELECT *, row_number() OVER (PARTITION BY pnu, nh ORDER BY building, dong, floor, ho, price, prvuse, share NULLS FIRST) AS rn FROM o) WHERE rn = 1)
        SELECT r.request_id, coalesce(par.total, 0) AS total, r.ho <> '' AND hit.pnu IS NOT NULL AS is_matched,
        r.ho = '' AND coalesce(par.total, 0) > 1 AS needs_unit, CASE WHEN r.ho <> '' THEN hit.t WHEN par.total = 1 THEN only_t END AS price
        FROM requests r LEFT JOIN par ON par.pnu = r.pnu LEFT JOIN hit ON hit.pnu = r.pnu AND r.ho <> '' AND hit.nh = {token('r.ho')}""",
        "officetel", "requests",
    ),
    "j06_two_year_match": with_views(
        f"""WITH {_TWO_YEARS} SELECT request_id, price, price_last, price - price_last AS delta,
        concat_ws(' / ', CASE WHEN total_last = 0 THEN '해당 PNU 공시가격 없음' WHEN total_last > 1 THEN concat('세대 ', total_last, '건 - 동·호를 입력해야 특정 가능') END,
        CASE WHEN price IS NOT NULL AND same <> 1 THEN concat('전년도에서 동일 세대를 확인하지 못해 비교 생략',
        CASE WHEN candidates = 0 THEN '' WHEN same > 0 THEN concat('(동일키 ', same, '건)') ELSE '(해당 세대 없음)' END) END) AS notes FROM two""",
        "unit_price", "requests",
    ),
    "j06_officetel_two_years": with_views(
        f"""WITH o AS (SELECT *, {token('ho')} AS nh, concat_ws('|', {token('dong')}, {token('floor')}, {token('ho')}) AS k, {_TOTAL} AS t FROM officetel),
        c AS (SELECT * FROM o WHERE year = '2026'), par AS (SELECT pnu, count(*) AS total, min(t) AS only_t, min(k) AS only_k FROM c GROUP BY pnu),
        hit AS (SELECT pnu, nh, t, k FROM (SELECT *, row_number() OVER (PARTITION BY pnu, nh ORDER BY building, dong, floor, ho, price, prvuse, share NULLS FIRST) AS rn FROM c) WHERE rn = 1),
        lk AS (SELECT pnu, k, count(*) AS n, min(t) AS t FROM o WHERE year = '2025' GROUP BY pnu, k),
        j AS (SELECT r.request_id, r.pnu, CASE WHEN r.ho <> '' THEN hit.t WHEN par.total = 1 THEN only_t END AS price, CASE WHEN r.ho <> '' THEN hit.k ELSE only_k END AS k
        FROM requests r LEFT JOIN par ON par.pnu = r.pnu LEFT JOIN hit ON hit.pnu = r.pnu AND r.ho <> '' AND hit.nh = {token('r.ho')})
        SELECT j.request_id, j.price, CASE WHEN lk.n = 1 THEN lk.t END AS price_last FROM j LEFT JOIN lk ON lk.pnu = j.pnu AND lk.k = j.k""",
        "officetel", "requests",
    ),
    "j08_not_found": with_views(
        f"""WITH {MATCHED}, dl AS (SELECT pnu, count(*) AS n, string_agg(nd, ', ' ORDER BY nd) FILTER (rn <= 10) AS l FROM
          (SELECT pnu, nd, row_number() OVER (PARTITION BY pnu ORDER BY nd) AS rn FROM (SELECT DISTINCT pnu, nd FROM cu WHERE nd <> '')) GROUP BY pnu),
        hl AS (SELECT pnu, nd, count(*) AS n, string_agg(nh, ', ' ORDER BY nh) FILTER (rn <= 8) AS l FROM
          (SELECT pnu, nd, nh, row_number() OVER (PARTITION BY pnu, nd ORDER BY nh) AS rn FROM (SELECT DISTINCT pnu, nd, nh FROM cu)) GROUP BY pnu, nd)
        SELECT request_id, concat_ws(' / ', CASE WHEN total = 0 THEN '해당 PNU 공시가격 없음' END,
        CASE WHEN total > 0 AND dong <> '' AND (hl.n IS NULL OR qd = '') THEN concat('입력한 ', dong, '동이 조회된 세대에 없어요 (조회된 동 ', coalesce(dl.n, 0), '개: ', coalesce(dl.l, ''), CASE WHEN dl.n > 10 THEN '…' ELSE '' END, ')') END,
        CASE WHEN total > 0 AND dong <> '' AND hl.n > 0 AND qd <> '' THEN concat(dong, '동에 ', ho, '호가 없어요 (', dong, '동 ', hl.n, '세대: ', hl.l, '…)') END,
        CASE WHEN total = 1 AND ho <> '' AND {token('only_ho')} <> '' AND {token('only_ho')} <> qh THEN concat('입력 호(', ho, ')와 자료상 호(', only_ho, ')가 달라요 - 확인 필요') END,
        CASE WHEN needs_unit AND (dong <> '' OR ho <> '') THEN concat('동/호 미매칭 - 세대 ', total, '건 중 특정 실패(동·호 확인 필요)')
             WHEN needs_unit THEN concat('세대 ', total, '건 - 동·호를 입력해야 특정 가능') END) AS reasons
        FROM m LEFT JOIN dl ON dl.pnu = m.pnu LEFT JOIN hl ON hl.pnu = m.pnu AND hl.nd = m.qd WHERE candidates = 0""",
        "unit_price", "requests",
    ),
    "j09_elsewhere": with_views(
        f"""WITH {MATCHED}, e AS (SELECT pnu, nh, count(*) AS n, string_agg(nd, ',' ORDER BY nd) FILTER (rn <= 6) AS l FROM
          (SELECT pnu, nh, nd, row_number() OVER (PARTITION BY pnu, nh ORDER BY nd) AS rn FROM (SELECT DISTINCT pnu, nh, nd FROM cu WHERE nd <> '')) GROUP BY pnu, nh)
        SELECT request_id, e.n AS elsewhere_count, e.l AS dongs FROM m JOIN e ON e.pnu = m.pnu AND e.nh = trim(m.ho) WHERE m.candidates = 0 AND m.dong <> '' AND m.ho <> ''""",
        "unit_price", "requests",
    ),
    "a22_available_units": with_views(
        f"WITH {MATCHED} SELECT DISTINCT pnu, trim(dong) AS dong, trim(ho) AS ho FROM cu WHERE pnu IN (SELECT pnu FROM m WHERE needs_unit)",
        "unit_price", "requests",
    ),
    "o06_natural_order": with_views(
        """SELECT DISTINCT dong, ho, TRY_CAST(regexp_extract(dong, '([0-9]+)', 1) AS BIGINT) AS dong_number, TRY_CAST(regexp_extract(ho, '([0-9]+)', 1) AS BIGINT) AS ho_number
        FROM unit_price""",
        "unit_price",
    ),
    "p15_unit_browse": with_views(
        f"""WITH u AS (SELECT DISTINCT pnu, {token('dong')} AS d, {token('ho')} AS u FROM unit_price WHERE year = '2026'),
        q AS (SELECT request_id, pnu, CASE WHEN request_id % 2 = 0 THEN substr(dong, 1, 2) ELSE dong END AS d, substr(ho, 1, 1) AS h FROM requests),
        hd AS (SELECT pnu, max(d <> '') AS has_dong FROM u GROUP BY pnu),
        dm AS (SELECT q.request_id, count(*) AS c FROM q JOIN (SELECT DISTINCT pnu, d FROM u WHERE d <> '') x ON x.pnu = q.pnu AND starts_with(x.d, q.d) GROUP BY 1),
        hm AS (SELECT q.request_id, count(*) AS c FROM q JOIN hd ON hd.pnu = q.pnu JOIN u ON u.pnu = q.pnu AND (NOT has_dong OR (u.d = q.d AND q.d <> '')) AND starts_with(u.u, q.h) GROUP BY 1)
        SELECT q.request_id, coalesce(dm.c, 0) AS dong_matches, coalesce(hm.c, 0) AS ho_matches FROM q LEFT JOIN dm ON dm.request_id = q.request_id LEFT JOIN hm ON hm.request_id = q.request_id""",
        "unit_price", "requests",
    ),
    "u04_distinct_units": with_views(
        "SELECT pnu, count(*) AS labels FROM (SELECT DISTINCT pnu, dong, ho FROM unit_price WHERE year = '2026') GROUP BY pnu", "unit_price"
    ),
    "k01_build_pnu": f"""WITH {_LOTS}, p AS (SELECT *, CASE WHEN NOT regexp_matches(code, '^[0-9]{{10}}$') THEN 'code_not_10_digits'
        WHEN NOT regexp_matches(main_lot, '^[0-9]*$') THEN 'main_lot_not_numeric' WHEN length(main_lot) > 4 THEN 'main_lot_too_long' END AS problem FROM lots)
        SELECT l_orderkey, l_linenumber, CASE WHEN problem IS NULL THEN concat(code, flag, lpad(main_lot, 4, '0'), CASE WHEN sub_lot = '' THEN '0000' ELSE lpad(sub_lot, 4, '0') END) END AS pnu, problem FROM p""",
    "k02_mountain_flags": """WITH v AS (SELECT CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN 'y' WHEN 3 THEN '산12' WHEN 4 THEN '2' WHEN 5 THEN NULL ELSE '0' END AS value FROM lineitem)
        SELECT value, CASE WHEN value = '1' THEN '2' ELSE '1' END AS juso, CASE WHEN upper(value) = 'Y' THEN '2' ELSE '1' END AS kakao,
        CASE WHEN value = '2' OR contains(value, '산') THEN '2' ELSE '1' END AS pnu, count(*) AS rows FROM v GROUP BY ALL""",
    "k03_pad_lot": f"""WITH {_LOTS} SELECT CASE WHEN regexp_matches(main_lot, '^[0-9]{{1,4}}$') THEN lpad(main_lot, 4, '0') END AS main_lot, count(*) AS rows FROM lots GROUP BY 1""",
    "k04_split_pnu": with_views(
        "SELECT DISTINCT pnu, substr(pnu, 1, 10) AS code, substr(pnu, 11, 1) AS flag, substr(pnu, 12, 4) AS main_lot, substr(pnu, 16, 4) AS sub_lot FROM unit_price",
        "unit_price",
    ),
    "k05_unit_tokens": with_views(
        f"""WITH l AS (SELECT dong AS label FROM unit_price UNION ALL SELECT concat('B', ho) FROM unit_price UNION ALL SELECT ho FROM unit_price)
        SELECT label, {token('label')} AS token, count(*) AS rows FROM l GROUP BY ALL""",
        "unit_price",
    ),
    "k06_unit_keys": with_views(
        f"SELECT pnu, year, concat_ws('|', {token('dong')}, {token('floor')}, {token('ho')}) AS unit_key, count(*) AS rows FROM unit_price GROUP BY ALL", "unit_price"
    ),
    "k07_register_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN lpad(CAST(o_orderkey AS VARCHAR), 14, '7') END AS register_number FROM orders",
    "k17_officetel_totals": with_views(
        f"SELECT pnu, floor, ho, year, price, prvuse, {_TOTAL} AS total_price, round_even(prvuse + coalesce(share, 0.0::DOUBLE), 2) AS total_area FROM officetel", "officetel"
    ),
    "s06_officetel_ingest": f"""WITH {_SHEETS} SELECT concat(ldcode, CASE WHEN special = '산' THEN '2' ELSE '1' END, lpad(lot, 4, '0'), lpad(sub, 4, '0')) AS pnu, ldcode, building, dong, floor, ho,
        prvuse, share, price, '2026' AS year FROM sh WHERE kind = '오피스텔' AND lot <> 'x1' AND (ldcode LIKE '110000000%' OR ldcode LIKE '110000001%' OR ldcode LIKE '110000004%')""",
    "s06_ingest_skipped": f"WITH {_SHEETS} SELECT count(*) FILTER (lot <> 'x1') AS loaded, count(*) FILTER (lot = 'x1') AS skipped FROM sh WHERE kind = '오피스텔'",
    "s07_upsert_latest": with_views(
        """WITH loads AS (SELECT *, 1 AS seq FROM officetel UNION ALL SELECT * REPLACE (price + 7 AS price), 2 AS seq FROM officetel WHERE CAST(ho AS INTEGER) % 2 = 1)
        SELECT pnu, floor, ho, year, price, prvuse FROM (SELECT *, row_number() OVER (PARTITION BY pnu, building, dong, floor, ho, year
        ORDER BY seq DESC, prvuse DESC, share DESC NULLS LAST, price DESC) AS rn FROM loads) WHERE rn = 1""",
        "officetel",
    ),
    "w09_latest_version": with_views(
        """WITH loads AS (SELECT *, 1 AS seq FROM officetel UNION ALL SELECT * REPLACE (price + 7 AS price), 2 AS seq FROM officetel WHERE CAST(ho AS INTEGER) % 2 = 1)
        SELECT year, count(*) AS rows, CAST(sum(price) AS BIGINT) AS price_sum FROM (SELECT *, row_number() OVER (PARTITION BY pnu, building, dong, floor, ho, year
        ORDER BY seq DESC, prvuse DESC, share DESC NULLS LAST, price DESC) AS rn FROM loads) WHERE rn = 1 GROUP BY year""",
        "officetel",
    ),
    "s16_load_report": with_views(
        "SELECT year, count(*) AS rows, count(DISTINCT pnu) AS parcels FROM (SELECT DISTINCT pnu, building, dong, floor, ho, year FROM officetel) GROUP BY year", "officetel"
    ),
}

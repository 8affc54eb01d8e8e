"""Address parsing, the resolution ladder, response decoding and the full lookup
(J7, J10-J13, A15, K8-K16, K33, S8-S10, U3, T1 batch function)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...functions import address as A
from ...functions import confidence as C
from ...operators import geocode as G
from ...session import scratch_path
from ...sources import responses as R
from ...sources.views import _CUT, _FULL, _LOT, table, view, with_views
from ...streaming.page_stream import start_page_stream
from .. import lookup as P
from .units import MATCHED, _TOTAL, _TWO_YEARS, token

# Every spelling of request the parser knows, built from the address parts.
_VARIANT = f"""CASE CAST(request_id % 8 AS INT)
 WHEN 0 THEN {_FULL}
 WHEN 1 THEN concat('서울특별시   물결구 누리동 산 ', n, ' 솔밭빌 B', h, '호')
 WHEN 2 THEN concat('경기 성남시 햇살구 은빛동 ', n, '-', m, ' 외 3필지 꽃잎마을 제', f, '동 제', h, '호')
 WHEN 3 THEN concat('서울 바람구 달맞이로 ', n, '길 ', m)
 WHEN 4 THEN concat('부산 중앙동 ', n)
 WHEN 5 THEN concat('강원 춘천시 동면 ', n, '-', m, ' 지하 1층 ', h, '호')
 WHEN 6 THEN '   '
 ELSE concat(lpad(n, 4, '1'), '-2007-', lpad(m, 6, '0')) END"""

_TEXTS = f"WITH address_parts AS ({{parts}}) SELECT request_id, n, m, f, h, {_VARIANT} AS q FROM address_parts"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "address_parts").selectExpr("request_id", "n", "m", "f", "h", f"{_VARIANT} AS q")


def k08_input_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.parse_address(_texts(spark, sf), "q")
    return rows.select("request_id", A.input_class(F.col("q"), F.col("parsed")).alias("input_type"))


def k09_address_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.parse_address(_texts(spark, sf), "q")
    fields = [f"parsed.{f}" for f in A.FIELDS if f != "warnings"]
    return rows.select("request_id", *fields, F.array_join("parsed.warnings", " / ").alias("notes"))


def k10_derived_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.parse_address(_texts(spark, sf), "q")
    p = F.col("parsed")
    return rows.select("request_id", A.lot_number(p).alias("lot"), A.lot_address(p).alias("lot_address"), A.search_query(p).alias("search_query"))


def k11_stripped_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "address_parts").selectExpr("request_id", "n", "m", "f", "h", f"{_FULL} AS q")
    tailed = F.concat(F.lit("물결구 새봄빌라 "), F.col("f"), F.lit("동 "), F.col("h"), F.lit("호"))
    return rows.select(
        "request_id", A.strip_detail(F.col("q")).alias("without_detail"), A.strip_unit_tail(tailed, F.col("f"), F.col("h")).alias("without_tail")
    )


def k12_query_choice(spark: SparkSession, sf: str) -> DataFrame:
    rows = _texts(spark, sf).withColumn("ho", F.when(F.col("request_id") % 3 == 0, "77"))
    chosen = P.with_query(P.route(rows.select("request_id", "q", "ho")))
    return chosen.select("request_id", "query", "dong", "ho")


def a15_parcel_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = G.parcel_groups(view(spark, sf, "primary_candidates"))
    return groups.select("query", F.col("key").alias("pnu"), "item.pos", "item.road_address")


def j10_register_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Register numbers with a known address for every second lot."""
    texts = _texts(spark, sf)
    book = texts.where("request_id % 8 = 7 AND CAST(n AS INT) % 2 = 0").select(
        F.regexp_replace("q", "-", "").alias("register_number"), F.lit("서울 물결구 누리동 86-15 새봄빌라 제202호").alias("address")
    )
    routed = P.route(texts.select("request_id", "q"), book)
    return routed.where("register_number IS NOT NULL").select("request_id", "register_number", "needs_address_lookup", "parsed.main_lot", "parsed.ho")


def j11_parcel_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = G.primary_results(view(spark, sf, "primary_candidates"))
    return found.select("query", "ok", "ambiguous", "pnu", "is_apartment", "candidates", F.array_join("warnings", " / ").alias("notes"))


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    requests = view(spark, sf, "address_parts").selectExpr("request_id", f"{_FULL} AS query")
    return G.resolve(requests, view(spark, sf, "primary_candidates"), view(spark, sf, "secondary_candidates"))


def j12_query_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return _ladder(spark, sf).select(
        "request_id", "geo_ok", "ambiguous", "geo_tier", "rung", "geo_pnu", F.array_join("geo_warnings", " / ").alias("notes")
    )


def u03_first_success(spark: SparkSession, sf: str) -> DataFrame:
    found = _ladder(spark, sf)
    return found.groupBy(F.coalesce("rung", F.lit(0)).alias("rung"), "ambiguous").agg(F.count(F.lit(1)).alias("requests"))


def k33_refinement(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses refined in bulk; the landed results are keyed by the derived search text."""
    requests = view(spark, sf, "address_parts").selectExpr("request_id", f"{_FULL} AS q")
    full_name = F.regexp_replace("query", "^서울 ", "서울특별시 ")
    primary = view(spark, sf, "primary_candidates").withColumn("query", full_name)
    secondary = view(spark, sf, "secondary_candidates").withColumn("query", full_name)
    refined = P.refine(requests, P.Sources(None, None, primary, secondary))
    return refined.select("request_id", "ok", "input_type", "pnu", "pnu_parts.main_lot", "dong", "ho", "tier", "ambiguous", F.size("warnings").alias("warnings"))


def _known_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "requests").select(
        "request_id", F.concat(F.lit("서울 물결구 누리동 "), F.col("request_id").cast("string")).alias("q"), "dong", "ho", "pnu"
    )


# A tenth of the parcels stand under another province in the unit table, so that their requests end at the office table.
_MOVED_PNU = "CASE WHEN substr(pnu, 15, 1) = '3' THEN concat('99', substr(pnu, 3)) ELSE pnu END"
_MOVED = f"* REPLACE ({_MOVED_PNU} AS pnu)"


def _sources(spark: SparkSession, sf: str) -> P.Sources:
    return P.Sources(
        view(spark, sf, "unit_price").withColumn("pnu", F.expr(_MOVED_PNU)), view(spark, sf, "officetel"),
        view(spark, sf, "primary_candidates"), view(spark, sf, "secondary_candidates"),
    )


def j07_source_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Full lookup of requests with a known parcel: source, price, change, score, status."""
    found = P.lookup(_known_parcels(spark, sf), _sources(spark, sf), "2026", "2025")
    return found.select(
        "request_id", "property_type", "is_target", "needs_unit", "price_this", "price_last", "price_delta", "confidence_score", "confidence_grade",
        "needs_manual_check", "status",
    )


def k15_checks(spark: SparkSession, sf: str) -> DataFrame:
    found = P.lookup(_known_parcels(spark, sf), _sources(spark, sf), "2026", "2025")
    state = lambda i: F.col("checks")[i]["state"]
    return found.groupBy("status", state(0).alias("address"), state(1).alias("unit"), state(2).alias("price"), state(3).alias("compare"), state(4).alias("registry")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def e1_address_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text requests of every spelling through the whole job."""
    found = P.lookup(_texts(spark, sf).select("request_id", "q"), _sources(spark, sf), "2026", "2025")
    return found.select("request_id", "input_type", "pnu", "dong", "ho", "ambiguous", "confidence_score", "status", F.size("warnings").alias("warnings"))


def j13_known_parcel(spark: SparkSession, sf: str) -> DataFrame:
    """Every third request brings its parcel; only the others walk the ladder."""
    requests = view(spark, sf, "address_parts").selectExpr("request_id", f"{_FULL} AS q", "CASE WHEN request_id % 3 = 0 THEN '1165010700100180000' END AS pnu")
    found = P.resolve_parcels(requests, _sources(spark, sf))
    return found.select("request_id", "pnu", F.coalesce("geo_tier", F.lit(0)).alias("tier"))


def k13_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("tier"), (F.col("l_quantity") > 20).alias("lot"), (F.col("l_returnflag") == "N").alias("ho"),
        (F.col("l_linestatus") == "F").alias("reg"),
        F.expr("array('호 미인식', concat('경고', CAST(l_suppkey % 3 AS STRING)), '경고1', concat('도로명주소 ', CAST(l_linenumber AS STRING)))").alias("w"),
    )
    points = C.score(F.col("tier"), F.col("lot"), F.col("ho"), F.col("reg"), F.col("w"))
    scored = rows.withColumn("score", points)
    return scored.select(
        "l_orderkey", "l_linenumber", "score", C.grade(F.col("score")).alias("grade"), C.needs_manual_check(C.grade(F.col("score"))).alias("manual"),
        F.size(C.signals(F.col("tier"), F.col("lot"), F.col("ho"), F.col("reg"))).alias("signals"), F.size(C.notes(F.col("tier"), F.col("ho"), F.col("w"))).alias("notes"),
    )


def k16_price_change(spark: SparkSession, sf: str) -> DataFrame:
    units = view(spark, sf, "housing_units")
    last = F.when(F.col("l_linenumber") != 2, F.floor(F.col("price") * F.when(F.col("l_orderkey") % 2 == 0, 0.97).otherwise(1.03)).cast("bigint"))
    rows = units.select("l_orderkey", "l_linenumber", "price", last.alias("last")).withColumn("d", C.delta(F.col("last"), F.col("price")))
    return rows.select("l_orderkey", "l_linenumber", "price", "last", "d.delta", F.round("d.percent", 6).alias("percent"), "d.direction")


def _price_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One landed response per order line, in every envelope the provider uses."""
    price = F.when(F.col("l_linenumber") == 6, "n/a").otherwise(F.format_number(F.floor(F.col("l_extendedprice") * 6000), 0))
    unit = F.struct(
        F.col("l_orderkey").cast("string").alias("pnu"), F.concat(F.lit("단지"), F.col("l_suppkey").cast("string")).alias("aphusNm"),
        F.lit("다세대").alias("aphusSeCodeNm"), F.lit("").alias("dongNm"), F.col("l_linenumber").cast("string").alias("hoNm"), price.alias("pblntfPc"),
    )
    total = F.lit(1).alias("totalCount")
    wrap = lambda inner, name: F.to_json(F.struct(inner.alias(name)))
    bodies = (
        F.when(F.col("l_linenumber") == 1, wrap(F.struct(total, F.struct(F.array(unit).alias("field")).alias("fields")), "apartHousingPrices"))
        .when(F.col("l_linenumber") == 2, wrap(F.struct(total, F.array(unit).alias("field")), "response"))
        .when(F.col("l_linenumber") == 3, F.to_json(F.struct(total, F.struct(unit.alias("field")).alias("fields"))))
        .when(F.col("l_linenumber") == 4, wrap(F.struct(F.lit("INCORRECT_KEY").alias("resultCode"), F.lit("bad key").alias("resultMsg")), "apartHousingPrices"))
        .when(F.col("l_linenumber") == 5, wrap(F.struct(F.lit("0").alias("totalCount"), F.array().cast("array<string>").alias("field")), "apartHousingPrices"))
        .otherwise(wrap(F.struct(total, F.array(unit).alias("fields")), "apartHousingPrices"))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bodies.alias("body"))


def s08_price_responses(spark: SparkSession, sf: str) -> DataFrame:
    decoded = R.decode_price_bodies(_price_bodies(spark, sf))
    return R.explode_units(decoded, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "unit_pnu", "name", "ho", "price")


def s08_response_errors(spark: SparkSession, sf: str) -> DataFrame:
    decoded = R.decode_price_bodies(_price_bodies(spark, sf))
    return decoded.groupBy("l_linenumber", "error_code", "total", F.size("rows").alias("rows")).agg(F.count(F.lit(1)).alias("responses"))


def s09_address_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Landed address answers of both providers, built from the candidate views."""
    c = F.col
    item = F.struct(
        c("adm_code").alias("admCd"), c("mountain").alias("mtYn"), c("main_lot").alias("lnbrMnnm"), c("sub_lot").alias("lnbrSlno"),
        c("road_address").alias("roadAddr"), c("building_kind").alias("bdKdcd"),
    )
    bad = c("main_lot").cast("int") % 7 == 0
    first = view(spark, sf, "primary_candidates").select(
        F.concat_ws("#", "query", c("pos").cast("string")).alias("query"),
        F.to_json(F.struct(F.struct(
            F.struct(F.when(bad, "E0006").otherwise("0").alias("errorCode"), F.lit("주소를 상세히 입력").alias("errorMessage")).alias("common"),
            F.array(item).alias("juso"),
        ).alias("results"))).alias("body"),
    )
    docs = F.struct(F.array(F.struct(F.struct(c("adm_code").alias("b_code"), c("main_lot").alias("main_address_no"), c("address_name")).alias("address"))).alias("documents"))
    second = view(spark, sf, "secondary_candidates").select("query", F.to_json(docs).alias("body"))
    one = R.decode_primary(first).select(F.lit("primary").alias("provider"), "query", "adm_code", "main_lot", "error")
    two = R.decode_secondary(second).select(F.lit("secondary").alias("provider"), "query", "adm_code", "main_lot", F.lit(None).cast("string").alias("error"))
    return one.unionByName(two)


def s10_paged_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as parcels, their lines as pages; page 3 of some is an error and totals may not be reached."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    unit = F.struct(F.col("s").cast("string").alias("pnu"), F.col("l_linenumber").cast("string").alias("hoNm"), F.lit("1000").alias("pblntfPc"))
    body = F.when(
        (F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 2 == 0), F.lit('{"apartHousingPrices":{"resultCode":"SYSTEM_ERROR"}}')
    ).otherwise(F.to_json(F.struct(F.struct(F.lit(4).alias("totalCount"), F.array(unit).alias("field")).alias("apartHousingPrices"))))
    landed = lines.select(F.col("l_orderkey").cast("string").alias("pnu"), F.lit("2026").alias("year"), F.col("l_linenumber").alias("page"), body.alias("body"))
    return R.completeness(R.decode_price_bodies(landed)).select("pnu", "received", "expected", F.col("pages").cast("int").alias("pages"), "complete")


def _many_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as parcels with a unit per order line, seven a page, so that most have more than twenty pages.

    By parcel, page 25 is an error, page 2 is missing, or only 100 units are announced; else all pages are read.
    """
    s = F.col("s")
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    pages = sizes.withColumn("page", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / 7).cast("int")))).where((s % 4 != 3) | (F.col("page") != 2))
    numbers = F.sequence((F.col("page") - 1) * 7 + 1, F.least(F.col("page") * 7, F.col("n").cast("int")))
    units = F.transform(numbers, lambda h: F.struct(s.cast("string").alias("pnu"), h.cast("string").alias("hoNm"), F.format_number(s * 1000 + h, 0).alias("pblntfPc"), F.lit("2026").alias("stdrYear")))
    total = F.when(s % 4 == 2, F.lit(100)).otherwise(F.col("n"))
    envelope = F.to_json(F.struct(F.struct(total.alias("totalCount"), units.alias("field")).alias("apartHousingPrices")))
    body = F.when((s % 4 == 1) & (F.col("page") == 25), F.lit('{"apartHousingPrices":{"resultCode":"SYSTEM_ERROR"}}')).otherwise(envelope)
    return pages.select(s.cast("string").alias("pnu"), F.lit("2026").alias("year"), "page", body.alias("body"))


def s10_reassembled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Units of parcels of many pages."""
    rows = R.reassemble(R.decode_price_bodies(_many_pages(spark, sf)))
    return rows.select("pnu", "year", "unit_pnu", F.col("ho").cast("bigint").alias("ho"), "price")


def t01_page_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same pages landed as files in no order, streamed in several batches, the units read back."""
    inbox, units, checkpoint = (scratch_path(spark, n) for n in ("pages", "page-units", "page-stream"))
    _many_pages(spark, sf).repartition(6, F.xxhash64("pnu", "page")).write.json(inbox)
    start_page_stream(spark, inbox, units, checkpoint, files_per_batch=2).awaitTermination()
    return spark.read.parquet(units).select("pnu", "year", "unit_pnu", F.col("ho").cast("bigint").alias("ho"), "price")


def j11_region_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All candidate parcels of the ambiguous queries, one row each, with the key to look up next."""
    primary = view(spark, sf, "primary_candidates")
    return G.region_candidates(G.parcel_groups(primary), G.primary_results(primary).where("ambiguous"))


# Units of a parcel and year in pages of five.  The second page of some parcels never landed, so that later ones are not
# read either; the answer for others is an error.
_PAGE = "CAST(floor((row_number() OVER (PARTITION BY pnu, year ORDER BY dong, floor, ho, price, name, type) + 4) / 5) AS INT)"
_ERROR = """CASE WHEN substr(pnu, 15, 1) = '3' THEN CASE CAST(substr(pnu, 8, 3) AS INT) % 4 WHEN 0 THEN 'INCORRECT_KEY' WHEN 1 THEN 'SYSTEM_ERROR'
 WHEN 2 THEN 'OVER_REQUEST_LIMIT' ELSE 'UNAVAILABLE_KEY' END END"""
_GAP = "substr(pnu, 15, 1) IN ('1', '4', '7')"


def _landed_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The unit table as the pages a provider would have sent."""
    c = F.col
    unit = F.struct(
        c("dong").alias("dongNm"), c("floor").alias("floorNm"), c("ho").alias("hoNm"), c("price").cast("string").alias("pblntfPc"),
        c("name").alias("aphusNm"), c("type").alias("aphusSeCodeNm"),
    )
    paged = view(spark, sf, "unit_price").withColumn("page", F.expr(_PAGE))
    pages = paged.groupBy("pnu", "year", "page").agg(F.collect_list(unit).alias("field"), F.count(F.lit(1)).alias("n"))
    pages = pages.withColumn("total", F.sum("n").over(Window.partitionBy("pnu", "year")))
    sent = F.to_json(F.struct(F.struct(c("total").alias("totalCount"), F.struct("field").alias("fields")).alias("apartHousingPrices")))
    error = F.expr(_ERROR)
    failed = F.to_json(F.struct(F.struct(error.alias("resultCode")).alias("apartHousingPrices")))
    return pages.where(~F.expr(_GAP) | (c("page") != 2)).select("pnu", "year", "page", F.when(error.isNotNull(), failed).otherwise(sent).alias("body"))


def k14_landed_status(spark: SparkSession, sf: str) -> DataFrame:
    """The whole lookup over landed answers: every status a request can end with, errors and missing pages named.

    Requests with a known parcel, and texts that name two parcels (negative ids).
    """
    prices = R.price_tables(_landed_prices(spark, sf))
    # The search text of a request names the province in full.
    primary = view(spark, sf, "primary_candidates").withColumn("query", F.regexp_replace("query", "^서울 ", "서울특별시 "))
    sources = P.landed_sources(prices, view(spark, sf, "officetel"), primary, view(spark, sf, "secondary_candidates"))
    none = F.lit(None).cast("string")
    texts = view(spark, sf, "address_parts").where("kind = 3").select(
        (-1 - F.col("request_id")).alias("request_id"), F.expr(_FULL).alias("q"), none.alias("dong"), none.alias("ho"), none.alias("pnu")
    )
    found = P.lookup(_known_parcels(spark, sf).unionByName(texts), sources, "2026", "2025")
    told = F.filter(F.array_distinct("warnings"), lambda w: w.rlike("오류: |^★"))
    return found.select("request_id", "status", "price_this", F.array_join(told, " / ").alias("told"))


QUERIES = {
    f.__name__: f
    for f in (
        k08_input_class, k09_address_parse, k10_derived_texts, k11_stripped_texts, k12_query_choice, a15_parcel_groups, j10_register_lookup,
        j11_parcel_candidates, j12_query_ladder, u03_first_success, k33_refinement, j07_source_precedence, k15_checks, e1_address_lookup,
        j13_known_parcel, k13_confidence, k16_price_change, s08_price_responses, s08_response_errors, s09_address_responses, s10_paged_reassembly,
        s10_reassembled_rows, j11_region_candidates, k14_landed_status, t01_page_stream,
    )
}

_T = f"t AS (SELECT request_id, n, m, f, h, CAST(request_id % 8 AS INTEGER) AS v, {_VARIANT} AS q, {_FULL} AS full_q, {_CUT} AS cut_q, {_LOT} AS lot_q FROM address_parts)"
# The parts each spelling must parse to, stated directly.
_PARSED = f"""{_T}, p AS (SELECT *,
 CASE WHEN v IN (0, 1, 3) THEN '서울특별시' WHEN v = 2 THEN '경기도' WHEN v = 4 THEN '부산광역시' WHEN v = 5 THEN '강원특별자치도' END AS sido,
 CASE WHEN v IN (0, 1) THEN '물결구' WHEN v = 2 THEN '성남시 햇살구' WHEN v = 3 THEN '바람구' WHEN v = 5 THEN '춘천시' END AS sigungu,
 CASE WHEN v IN (0, 1) THEN '누리동' WHEN v = 2 THEN '은빛동' WHEN v = 4 THEN '중앙동' WHEN v = 5 THEN '동면' END AS emd,
 CASE WHEN v = 1 THEN '1' ELSE '0' END AS mountain,
 CASE WHEN v IN (0, 1, 2, 4, 5) THEN n WHEN v = 7 THEN lpad(n, 4, '1') END AS main_lot,
 CASE WHEN v IN (0, 2, 5) THEN m WHEN v IN (1, 4) THEN '0' WHEN v = 7 THEN '2007' END AS sub_lot,
 CASE WHEN v = 0 THEN '새봄빌라' WHEN v = 1 THEN '솔밭빌' WHEN v = 2 THEN '꽃잎마을' WHEN v = 3 THEN concat('달맞이로', n, '길') WHEN v = 7 THEN concat('-', lpad(m, 6, '0')) END AS building,
 CASE WHEN v = 2 THEN f END AS building_dong, CASE WHEN v = 3 THEN m END AS building_no,
 CASE WHEN v = 0 THEN concat('제', f) WHEN v = 5 THEN '지하1' END AS floor,
 CASE WHEN v IN (0, 2, 5) THEN h WHEN v = 1 THEN concat('B', h) END AS ho, v = 3 AS is_road,
 CASE v WHEN 2 THEN '복수필지(외 N필지) - 대표필지로 처리됨' WHEN 3 THEN '호 미인식 / 읍면동 미인식 / 도로명주소 - 지번은 juso 정제 필요' WHEN 4 THEN '호 미인식' WHEN 6 THEN '빈 입력' WHEN 7 THEN '호 미인식 / 읍면동 미인식' ELSE '' END AS notes FROM t)"""
_LADDER = f"""{_T}, pq AS (SELECT query, count(DISTINCT concat(main_lot, '-', sub_lot)) AS parcels, max(history) AS history, max(main_lot) AS main_lot FROM primary_candidates GROUP BY query),
 sq AS (SELECT DISTINCT query FROM secondary_candidates),
 l AS (SELECT t.*, CASE WHEN p1.query IS NOT NULL THEN 1 WHEN p2.query IS NOT NULL THEN 2 WHEN s3.query IS NOT NULL THEN 3 WHEN p4.query IS NOT NULL THEN 4 END AS rung,
 coalesce(p1.history, p2.history) AS history FROM t LEFT JOIN pq p1 ON p1.query = full_q LEFT JOIN pq p2 ON p2.query = cut_q LEFT JOIN sq s3 ON s3.query = full_q LEFT JOIN pq p4 ON p4.query = lot_q),
 lad AS (SELECT *, coalesce(rung < 4, false) AS geo_ok, coalesce(rung = 4, false) AS ambiguous, CAST(CASE WHEN rung IN (1, 2) THEN 1 WHEN rung = 3 THEN 2 ELSE 0 END AS INTEGER) AS geo_tier,
 CASE WHEN rung < 4 THEN concat('47710253001', lpad(n, 4, '0'), lpad(m, 4, '0')) END AS geo_pnu,
 CASE WHEN rung = 1 THEN CASE WHEN history = '1' THEN '변동이력 있는 주소(과거주소 가능)' ELSE '' END
 WHEN rung = 2 THEN concat('juso 결과 없음', CASE WHEN history = '1' THEN ' / 변동이력 있는 주소(과거주소 가능)' ELSE '' END)
 WHEN rung = 3 THEN 'juso 결과 없음 / juso 결과 없음'
 WHEN rung = 4 THEN concat('juso 결과 없음 / juso 결과 없음 / 카카오 결과 없음 / 절삭검색 적용(''', lot_q, ''') / 동명이지 2곳 매칭(서울특별시 물결구 누리동 / 서울특별시 물결구 누리동) - 상위 행정구역 필요')
 ELSE 'juso 결과 없음 / juso 결과 없음 / 카카오 결과 없음 / 정제 실패 - 모든 폴백 소진' END AS notes FROM l)"""
_LADDER_VIEWS = ("address_parts", "primary_candidates", "secondary_candidates")
_KNOWN = f"""up2 AS ({{units}}), {_TWO_YEARS.replace('FROM unit_price)', 'FROM up2)')},
 o AS (SELECT *, {token('ho')} AS nh, concat_ws('|', {token('dong')}, {token('floor')}, {token('ho')}) AS k, {_TOTAL} AS t FROM officetel),
 oc AS (SELECT * FROM o WHERE year = '2026'), opar AS (SELECT pnu, count(*) AS total, min(t) AS only_t, min(k) AS only_k FROM oc GROUP BY pnu),
 ohit AS (SELECT pnu, nh, t, k FROM (SELECT *, row_number() OVER (PARTITION BY pnu, nh ORDER BY building, dong, floor, ho, price, prvuse, share NULLS FIRST) AS rn FROM oc) WHERE rn = 1),
 olk AS (SELECT pnu, k, count(*) AS n, min(t) AS t FROM o WHERE year = '2025' GROUP BY pnu, k), olp AS (SELECT pnu, count(*) AS n FROM o WHERE year = '2025' GROUP BY pnu),
 oj AS (SELECT r.request_id, r.pnu, CASE WHEN r.ho <> '' THEN ohit.t WHEN opar.total = 1 THEN only_t END AS ot, CASE WHEN r.ho <> '' THEN ohit.k ELSE only_k END AS ok,
  r.ho = '' AND coalesce(opar.total, 0) > 1 AS oneeds, r.ho <> '' AS ohm FROM requests r LEFT JOIN opar ON opar.pnu = r.pnu LEFT JOIN ohit ON ohit.pnu = r.pnu AND r.ho <> '' AND ohit.nh = {token('r.ho')}),
 b AS (SELECT two.*, oj.ot, oj.oneeds, oj.ohm, CASE WHEN olk.n = 1 THEN olk.t END AS olast, coalesce(olk.n, 0) AS osame, coalesce(olp.n, 0) AS ototal_last,
  CASE WHEN two.price IS NOT NULL THEN 'apt' WHEN needs_unit THEN 'apt_choice' WHEN ot IS NOT NULL THEN 'ofc' WHEN oneeds THEN 'ofc_choice' ELSE 'none' END AS src,
  CAST(substr(two.pnu, 8, 3) AS INTEGER) AS supp, EXISTS (SELECT 1 FROM up2 x WHERE x.pnu = two.pnu AND x.year = '2026' AND {token('x.dong')} = two.qd) AS dong_seen
  FROM two JOIN oj ON oj.request_id = two.request_id LEFT JOIN olk ON olk.pnu = oj.pnu AND olk.k = oj.ok AND oj.ot IS NOT NULL LEFT JOIN olp ON olp.pnu = oj.pnu),
 -- serious warnings: parsed text is a plain lot ("호 미인식" is benign)
 w AS (SELECT *, CASE src
  WHEN 'apt' THEN CASE WHEN total_last = 0 THEN 1 WHEN total_last > 1 THEN 1 ELSE 0 END + CASE WHEN same <> 1 THEN 1 ELSE 0 END + CASE WHEN price_last IS NULL THEN 1 ELSE 0 END
   + CASE WHEN candidates = 0 AND dong <> '' THEN 1 ELSE 0 END + CASE WHEN candidates = 0 AND ho <> '' AND {token('only_ho')} <> qh THEN 1 ELSE 0 END
  WHEN 'apt_choice' THEN CASE WHEN candidates > 1 THEN 1 ELSE 1 + CASE WHEN dong <> '' THEN 1 ELSE 0 END END
  WHEN 'ofc' THEN CASE WHEN ototal_last <> 1 THEN 1 ELSE 0 END + CASE WHEN osame <> 1 THEN 1 ELSE 0 END + CASE WHEN olast IS NULL THEN 1 ELSE 0 END
  WHEN 'ofc_choice' THEN 1
  ELSE 1 + CASE WHEN total_last = 0 AND total = 0 THEN 1 WHEN total_last > 1 OR total_last = 0 THEN 2 ELSE 1 END END AS serious FROM b),
 s AS (SELECT *, CASE src WHEN 'apt' THEN price WHEN 'ofc' THEN ot END AS price_this, CASE src WHEN 'apt' THEN price_last WHEN 'ofc' THEN olast END AS p_last,
  greatest(0, CASE WHEN src = 'apt_choice' OR src = 'ofc_choice' THEN 15 ELSE 15 + CASE WHEN (src = 'apt' AND candidates = 1) OR (src = 'ofc' AND ohm) THEN 28 ELSE 0 END END - 3 * serious) AS score FROM w),
 g AS (SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'F' END AS grade,
  CASE WHEN src LIKE '%_choice' THEN 'NEEDS_UNIT_SELECTION' WHEN price_this IS NOT NULL AND p_last IS NOT NULL THEN 'SUCCESS' WHEN price_this IS NOT NULL THEN 'SUCCESS_CURRENT_ONLY' ELSE 'NOT_FOUND' END AS status FROM s)"""
_KNOWN_MOVED = _KNOWN.replace("{units}", f"SELECT {_MOVED} FROM unit_price")
# What the pages tell: nothing where the answer is an error, the first page where the second is missing.
_KNOWN_LANDED = "paged AS (SELECT *, {page} AS page, count(*) OVER (PARTITION BY pnu, year) AS announced FROM unit_price), ".replace("{page}", _PAGE) + _KNOWN.replace(
    "{units}", f"SELECT * FROM paged WHERE {_ERROR} IS NULL AND NOT ({_GAP} AND page > 1)"
)

ORACLES = {
    "k08_input_class": with_views(
        f"WITH {_T} SELECT request_id, CASE v WHEN 0 THEN '등기부주소' WHEN 1 THEN '등기부주소' WHEN 2 THEN '등기부주소' WHEN 3 THEN '도로명주소' WHEN 4 THEN '지번주소' WHEN 5 THEN '등기부주소' WHEN 7 THEN '등기고유번호' END AS input_type FROM t",
        "address_parts",
    ),
    "k09_address_parse": with_views(
        f"WITH {_PARSED} SELECT request_id, sido, sigungu, emd, mountain, main_lot, sub_lot, building, building_dong, building_no, floor, ho, is_road, notes FROM p",
        "address_parts",
    ),
    "k10_derived_texts": with_views(
        f"""WITH {_PARSED}, d AS (SELECT *, CASE WHEN main_lot IS NULL THEN NULL WHEN sub_lot = '0' THEN main_lot ELSE concat(main_lot, '-', sub_lot) END AS lot FROM p),
        a AS (SELECT *, concat_ws(' ', sido, sigungu, emd, CASE WHEN mountain = '1' THEN '산' END, lot) AS lot_address FROM d)
        SELECT request_id, lot, lot_address, CASE WHEN is_road THEN concat_ws(' ', sido, sigungu, building, building_no) ELSE lot_address END AS search_query FROM a""",
        "address_parts",
    ),
    "k11_stripped_texts": with_views(f"WITH {_T} SELECT request_id, cut_q AS without_detail, '물결구 새봄빌라' AS without_tail FROM t", "address_parts"),
    "k12_query_choice": with_views(
        f"""WITH {_PARSED} SELECT request_id, CASE v WHEN 0 THEN concat('서울특별시 물결구 누리동 ', n, '-', m) WHEN 1 THEN concat('서울특별시 물결구 누리동 산 ', n)
        WHEN 2 THEN concat('경기도 성남시 햇살구 은빛동 ', n, '-', m) WHEN 3 THEN q WHEN 4 THEN concat('부산광역시 중앙동 ', n) WHEN 5 THEN concat('강원특별자치도 춘천시 동면 ', n, '-', m) END AS query,
        building_dong AS dong, CASE WHEN request_id % 3 = 0 THEN '77' ELSE ho END AS ho FROM p""",
        "address_parts",
    ),
    "a15_parcel_groups": with_views(
        """SELECT query, concat(adm_code, '1', lpad(main_lot, 4, '0'), lpad(sub_lot, 4, '0')) AS pnu, min(pos) AS pos, arg_min(road_address, pos) AS road_address
        FROM primary_candidates GROUP BY query, pnu""",
        "primary_candidates",
    ),
    "j10_register_lookup": with_views(
        f"""WITH {_T}, b AS (SELECT DISTINCT replace(q, '-', '') AS r FROM t WHERE v = 7 AND CAST(n AS INTEGER) % 2 = 0)
        SELECT request_id, replace(q, '-', '') AS register_number, b.r IS NULL AS needs_address_lookup, CASE WHEN b.r IS NOT NULL THEN '86' END AS main_lot,
        CASE WHEN b.r IS NOT NULL THEN '202' END AS ho FROM t LEFT JOIN b ON b.r = replace(q, '-', '') WHERE v = 7""",
        "address_parts",
    ),
    "j11_parcel_candidates": with_views(
        """WITH g AS (SELECT query, count(*) AS candidates, count(DISTINCT concat(main_lot, '-', sub_lot)) AS parcels, max(history) AS history, max(building_kind) AS kind,
        min(concat(adm_code, '1', lpad(main_lot, 4, '0'), lpad(sub_lot, 4, '0'))) AS pnu FROM primary_candidates GROUP BY query)
        SELECT query, parcels = 1 AS ok, parcels > 1 AS ambiguous, CASE WHEN parcels = 1 THEN pnu END AS pnu, CASE WHEN parcels = 1 THEN kind = '1' END AS is_apartment, candidates,
        CASE WHEN parcels > 1 THEN '동명이지 2곳 매칭(서울특별시 물결구 누리동 / 서울특별시 물결구 누리동) - 상위 행정구역 필요' WHEN history = '1' THEN '변동이력 있는 주소(과거주소 가능)' ELSE '' END AS notes FROM g""",
        "primary_candidates",
    ),
    "j12_query_ladder": with_views(f"WITH {_LADDER} SELECT request_id, geo_ok, ambiguous, geo_tier, rung, geo_pnu, notes FROM lad", *_LADDER_VIEWS),
    "u03_first_success": with_views(
        f"WITH {_LADDER} SELECT CAST(coalesce(rung, 0) AS INTEGER) AS rung, ambiguous, count(*) AS requests FROM lad GROUP BY 1, 2", *_LADDER_VIEWS
    ),
    "k33_refinement": with_views(
        f"""WITH {_T}, l AS (SELECT t.*, p4.query IS NOT NULL AS hit FROM t LEFT JOIN (SELECT DISTINCT query FROM primary_candidates) p4 ON p4.query = lot_q)
        SELECT request_id, false AS ok, '지번주소' AS input_type, CAST(NULL AS VARCHAR) AS pnu, CAST(NULL AS VARCHAR) AS main_lot, CAST(NULL AS VARCHAR) AS dong, h AS ho,
        0 AS tier, hit AS ambiguous, CAST(CASE WHEN hit THEN 2 ELSE 4 END AS INTEGER) AS warnings FROM l""",
        *_LADDER_VIEWS,
    ),
    "j07_source_precedence": with_views(
        f"""WITH {_KNOWN_MOVED} SELECT request_id, CASE WHEN src LIKE 'apt%' THEN CASE supp % 3 WHEN 0 THEN '아파트' WHEN 1 THEN '연립' ELSE '다세대' END WHEN src LIKE 'ofc%' THEN '오피스텔' END AS property_type,
        NOT (src LIKE 'apt%' AND supp % 3 = 0) AS is_target, src LIKE '%_choice' AS needs_unit, price_this, p_last AS price_last, price_this - p_last AS price_delta,
        CAST(score AS INTEGER) AS confidence_score, grade AS confidence_grade, grade IN ('C', 'F') AS needs_manual_check, status FROM g""",
        "unit_price", "requests", "officetel",
    ),
    "k15_checks": with_views(
        f"""WITH {_KNOWN_MOVED} SELECT status, 'PASS' AS address, CASE WHEN src LIKE '%_choice' THEN 'FAIL' WHEN price_this IS NOT NULL THEN 'PASS' ELSE 'UNKNOWN' END AS unit,
        CASE WHEN price_this IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS price, CASE WHEN p_last IS NOT NULL THEN 'PASS' WHEN price_this IS NOT NULL THEN 'UNKNOWN' ELSE 'SKIP' END AS compare,
        'SKIP' AS registry, count(*) AS requests FROM g GROUP BY ALL""",
        "unit_price", "requests", "officetel",
    ),
    "j13_known_parcel": with_views(
        f"""WITH {_T}, l AS (SELECT t.*, p4.query IS NOT NULL AS hit FROM t LEFT JOIN (SELECT DISTINCT query FROM primary_candidates) p4 ON p4.query = lot_q)
        SELECT request_id, CASE WHEN request_id % 3 = 0 THEN '1165010700100180000' END AS pnu, 0 AS tier FROM l""",
        *_LADDER_VIEWS,
    ),
    "k13_confidence": """WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS tier, l_quantity > 20 AS lot, l_returnflag = 'N' AS ho, l_linestatus = 'F' AS reg, CASE WHEN l_suppkey % 3 = 1 THEN 1 ELSE 2 END AS bad FROM lineitem),
        s AS (SELECT *, greatest(0, least(100, CASE tier WHEN 1 THEN 40 WHEN 2 THEN 22 ELSE 0 END + CASE WHEN lot THEN 15 ELSE 0 END + CASE WHEN ho THEN 28 ELSE 0 END + CASE WHEN reg THEN 17 ELSE 0 END - 3 * bad)) AS score FROM r)
        SELECT l_orderkey, l_linenumber, CAST(score AS INTEGER) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'F' END AS grade, score < 65 AS manual,
        CAST((CASE WHEN tier > 0 THEN 1 ELSE 0 END) + CAST(lot AS INTEGER) + CAST(ho AS INTEGER) + CAST(reg AS INTEGER) AS INTEGER) AS signals,
        CAST(2 + bad + CASE WHEN tier = 2 THEN 1 ELSE 0 END + CASE WHEN ho THEN 0 ELSE 1 END AS INTEGER) AS notes FROM s""",
    "k16_price_change": with_views(
        """WITH r AS (SELECT l_orderkey, l_linenumber, price, CASE WHEN l_linenumber <> 2 THEN CAST(floor(price * CASE WHEN l_orderkey % 2 = 0 THEN 0.97::DOUBLE ELSE 1.03::DOUBLE END) AS BIGINT) END AS last FROM housing_units)
        SELECT *, price - last AS delta, round((price - last)::DOUBLE / last * 100, 6) AS percent, CASE WHEN price >= last THEN 'up' WHEN price < last THEN 'down' END AS direction FROM r""",
        "housing_units",
    ),
    "s08_price_responses": """SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS unit_pnu, concat('단지', l_suppkey) AS name, CAST(l_linenumber AS VARCHAR) AS ho,
        CASE WHEN l_linenumber <> 6 THEN CAST(floor(l_extendedprice * 6000) AS BIGINT) END AS price FROM lineitem WHERE l_linenumber NOT IN (4, 5)""",
    "s08_response_errors": """SELECT l_linenumber, CASE WHEN l_linenumber = 4 THEN 'INCORRECT_KEY' END AS error_code, CAST(CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN 0 ELSE 1 END AS BIGINT) AS total,
        CAST(CASE WHEN l_linenumber IN (4, 5) THEN 0 ELSE 1 END AS INTEGER) AS rows, count(*) AS responses FROM lineitem GROUP BY ALL""",
    "s09_address_responses": with_views(
        """SELECT 'primary' AS provider, concat(query, '#', pos) AS query, CASE WHEN CAST(main_lot AS INTEGER) % 7 <> 0 THEN adm_code END AS adm_code, CASE WHEN CAST(main_lot AS INTEGER) % 7 <> 0 THEN main_lot END AS main_lot,
        CASE WHEN CAST(main_lot AS INTEGER) % 7 = 0 THEN '주소를 상세히 입력' END AS error FROM primary_candidates
        UNION ALL SELECT 'secondary', query, adm_code, main_lot, NULL FROM secondary_candidates""",
        "primary_candidates", "secondary_candidates",
    ),
    "s10_paged_reassembly": """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS page FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY page) AS rn FROM p)
        SELECT CAST(l_orderkey AS VARCHAR) AS pnu, count(*) AS received, CAST(4 AS BIGINT) AS expected, CAST(max(page) AS INTEGER) AS pages, count(*) >= 4 AS complete
        FROM r WHERE rn = page AND page <= 4 AND NOT (l_orderkey % 2 = 0 AND page >= 3) GROUP BY l_orderkey""",
    "s10_reassembled_rows": """WITH n AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY l_suppkey),
        h AS (SELECT s, unnest(range(1, least(n, CASE s % 4 WHEN 1 THEN 24 * 7 WHEN 2 THEN 15 * 7 WHEN 3 THEN 7 ELSE n END) + 1)) AS ho FROM n)
        SELECT CAST(s AS VARCHAR) AS pnu, '2026' AS year, CAST(s AS VARCHAR) AS unit_pnu, ho, s * 1000 + ho AS price FROM h""",
    "j11_region_candidates": with_views(
        """WITH k AS (SELECT *, concat(substr(adm_code, 1, 10), '1', lpad(main_lot, 4, '0'), lpad(sub_lot, 4, '0')) AS pnu FROM primary_candidates),
        g AS (SELECT query, pnu, min(pos) AS pos, min(sido) AS sido, min(sigungu) AS sigungu, min(emd) AS emd, arg_min(road_address, pos) AS address FROM k GROUP BY query, pnu)
        SELECT query, pos, pnu, substr(pnu, 1, 10) AS pnu_prefix, sido, sigungu, emd, address FROM g WHERE query IN (SELECT query FROM g GROUP BY query HAVING count(*) > 1)""",
        "primary_candidates",
    ),
    "k14_landed_status": with_views(
        f"""WITH {_KNOWN_LANDED}, e AS (SELECT *, {_ERROR} AS code FROM g), ann AS (SELECT pnu, max(announced) AS announced FROM paged WHERE year = '2026' GROUP BY pnu),
        k AS (SELECT e.*, announced, CASE WHEN src = 'none' AND code IS NOT NULL THEN concat(CASE WHEN code = 'SYSTEM_ERROR' THEN 'API' ELSE '인증' END, ' 오류: ', code)
        WHEN candidates = 0 AND total > 0 AND dong <> '' AND total < announced THEN concat('★세대 일부만 조회됨: ', total, '/', announced, '건 — 페이지 수신 누락 (이 때문에 못 찾았을 수 있어요)') ELSE '' END AS told
        FROM e LEFT JOIN ann ON ann.pnu = e.pnu)
        SELECT request_id, CASE WHEN told LIKE '인증%' THEN 'SOURCE_ERROR' ELSE status END AS status, price_this, told FROM k
        UNION ALL SELECT -1 - request_id, 'NEEDS_ADDRESS_SELECTION', NULL, '' FROM address_parts WHERE kind = 3""",
        "unit_price", "requests", "officetel", "address_parts",
    ),
}
ORACLES["t01_page_stream"] = ORACLES["s10_reassembled_rows"]

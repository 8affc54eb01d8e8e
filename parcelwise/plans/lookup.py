"""Price lookup of a request table: route, parse, resolve, match two years, choose, score.

``requests``: ``request_id`` (unique), ``q`` and optionally ``dong``, ``ho``, ``pnu``.
Every request comes back exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import confidence as C
from ..functions import keys as K
from ..operators import geocode, officetel, units
from ..session import stored
from ..sources.responses import PriceTables


@dataclass(frozen=True)
class Sources:
    """The tables a lookup reads."""

    units: DataFrame
    officetel: DataFrame
    primary: DataFrame
    secondary: DataFrame
    register: DataFrame | None = None  # register_number, address
    expected: DataFrame | None = None  # pnu, expected, and the year where several are told apart
    errors: DataFrame | None = None  # pnu, year, error_code


def landed_sources(prices: PriceTables, officetel: DataFrame, primary: DataFrame, secondary: DataFrame, register: DataFrame | None = None) -> Sources:
    """Sources whose housing prices are landed answers, with their totals and errors."""
    return Sources(prices.units, officetel, primary, secondary, register, prices.expected, prices.errors)


def route(requests: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """Classify requests and parse their addresses; register numbers are looked up first."""
    optional = [c for c in ("dong", "ho", "pnu") if c not in requests.columns]
    rows = requests.withColumns({c: F.lit(None).cast("string") for c in optional}) if optional else requests
    rows = rows.select(
        "request_id", F.trim(F.coalesce("q", F.lit(""))).alias("q"),
        *[F.nullif(F.trim(c), F.lit("")).alias(f"asked_{c}") for c in ("dong", "ho", "pnu")],
    ).withColumn("register_number", K.register_number(F.col("q")))
    if register is not None:
        known = register.groupBy("register_number").agg(F.min("address").alias("known_address"))
        # Most requests have no register number; they take no part in the join, where one task would get them all.
        without = rows.where(F.col("register_number").isNull()).withColumn("known_address", F.lit(None).cast("string"))
        rows = rows.where(F.col("register_number").isNotNull()).join(known, "register_number", "left").unionByName(without)
    else:
        rows = rows.withColumn("known_address", F.lit(None).cast("string"))
    is_number = F.col("register_number").isNotNull()
    rows = rows.withColumn("needs_address_lookup", is_number & (F.coalesce("known_address", F.lit("")) == ""))
    rows = rows.withColumn("address", F.when(is_number, F.col("known_address")).otherwise(F.col("q")))
    parsed = A.parse_address(rows, "address")
    return parsed.withColumn("input_type", A.input_class(F.col("q"), F.col("parsed")))


def with_query(routed: DataFrame) -> DataFrame:
    """Effective building, unit and search text: explicit values win over parsed ones."""
    p = F.col("parsed")
    rows = routed.withColumn("dong", F.coalesce("asked_dong", p["building_dong"])).withColumn("ho", F.coalesce("asked_ho", p["ho"]))
    stripped = F.nullif(A.strip_unit_tail(F.col("q"), F.col("dong"), F.col("ho")), F.lit(""))
    searched = F.coalesce(F.nullif(A.search_query(p), F.lit("")), F.col("q"))
    query = F.when(p["main_lot"].isNotNull(), searched).otherwise(F.coalesce(stripped, F.col("q")))
    return rows.withColumn("query", F.when(~F.col("needs_address_lookup") & (F.col("q") != ""), query))


def _no_text() -> Column:
    return F.array().cast("array<string>")


def choose(rows: DataFrame) -> DataFrame:
    """Pick the price source of every request: housing price, housing choice, office, office choice, none.

    Needs the structs ``apt`` and ``ofc`` (results of the two matches with last year attached).
    """
    apt, ofc = F.col("apt"), F.col("ofc")
    source = (
        F.when(apt["price"].isNotNull(), "apt")
        .when(F.coalesce(apt["needs_unit"], F.lit(False)), "apt_choice")
        .when(ofc["price"].isNotNull(), "ofc")
        .when(F.coalesce(ofc["needs_unit"], F.lit(False)), "ofc_choice")
        .otherwise("none")
    )
    rows = rows.withColumn("source", F.when(F.col("pnu").isNotNull(), source))
    unit = F.coalesce(apt["unit"], apt["single"], apt["sample"])
    from_apt, from_ofc = F.col("source").startswith("apt"), F.col("source").startswith("ofc")
    kind = F.coalesce(F.nullif(F.trim(unit["type"]), F.lit("")), F.lit("공동주택"))
    return rows.withColumns(
        {
            "property_type": F.when(from_apt, kind).when(from_ofc, "오피스텔"),
            "is_target": F.when(from_apt, ~kind.contains("아파트")).otherwise(F.lit(True)),
            "building_name": F.when(from_apt, unit["name"]).when(from_ofc, F.coalesce(ofc["unit"]["building"], ofc["sample"]["building"])),
            "needs_unit": F.coalesce(F.col("source").endswith("_choice"), F.lit(False)),
            "price_this": F.when(F.col("source") == "apt", apt["price"]).when(F.col("source") == "ofc", ofc["price"]),
            "price_last": F.when(F.col("source") == "apt", apt["price_last"]).when(F.col("source") == "ofc", ofc["price_last"]),
            "price_calc": F.when(F.col("source") == "ofc", officetel.price_basis(ofc["unit"])),
            "ho_matched": F.when(F.col("source") == "apt", apt["unit"].isNotNull()).when(F.col("source") == "ofc", ofc["is_matched"]).otherwise(F.lit(False)),
        }
    )


def _all_warnings() -> Column:
    apt, ofc, source = F.col("apt"), F.col("ofc"), F.col("source")
    current_only = F.when(
        F.col("price_this").isNotNull() & F.col("price_last").isNull(), F.array(F.lit("구 공시가 없음 - 변동 비교 불가(현재값만)"))
    ).otherwise(_no_text())
    outcome = (
        F.when(source == "apt", F.concat(apt["warnings_last"], apt["warnings"], current_only))
        .when(source == "apt_choice", apt["warnings"])
        .when(source == "ofc", F.concat(ofc["warnings_last"], ofc["warnings"], current_only))
        .when(source == "ofc_choice", ofc["warnings"])
        .when(source == "none", F.concat(F.array(F.lit("공시가격 미확인(공동주택·오피스텔 모두 없음)")), apt["warnings_last"], apt["warnings"]))
    )
    geo = F.concat(
        F.coalesce("geo_warnings", _no_text()),
        F.when(F.coalesce("ambiguous", F.lit(False)), F.array(F.lit("여러 지역에 같은 동명 - 시/도·시군구를 함께 입력하세요"))).otherwise(_no_text()),
        F.when(F.col("geo_problem").isNotNull(), F.array(F.concat(F.lit("PNU 조립 실패: "), F.col("geo_problem")))).otherwise(_no_text()),
    )
    return F.when(F.col("q") == "", _no_text()).when(
        F.col("needs_address_lookup"), F.array(F.lit("등기고유번호만 입력됨 - 보증DB 주소조회 필요"))
    ).otherwise(F.concat(F.col("parsed.warnings"), geo, F.coalesce(outcome, _no_text())))


def score_and_status(rows: DataFrame) -> DataFrame:
    """Warnings, confidence, status and checks of chosen rows."""
    rows = rows.withColumn("all_warnings", _all_warnings())
    has_parsed_lot = F.col("parsed.main_lot").isNotNull()
    priced = F.col("source").isin("apt", "ofc", "none")
    resolved = F.col("pnu").isNotNull()
    scored = C.score(
        F.when(resolved, F.coalesce("geo_tier", F.lit(0))).otherwise(0),
        F.when(resolved & priced, F.lit(True)).otherwise(has_parsed_lot),
        F.when(resolved, F.col("ho_matched")).otherwise(F.col("ho").isNotNull()),
        resolved & priced & (F.col("input_type") == "등기고유번호"),
        F.col("all_warnings"),
    )
    unscored = (F.col("q") == "") | F.col("needs_address_lookup") | F.col("geo_problem").isNotNull()
    rows = rows.withColumn("confidence_score", F.when(unscored, F.lit(0)).otherwise(scored))
    rows = rows.withColumn("confidence_grade", C.grade(F.col("confidence_score"))).withColumn("ok", F.col("price_this").isNotNull())
    return rows.select(
        "request_id", "ok", F.when(F.col("q") == "", F.lit("주소 또는 등기고유번호를 입력하세요.")).alias("error"), "input_type",
        F.col("refined_address"), "pnu", F.when(~F.col("needs_address_lookup"), F.col("dong")).alias("dong"),
        F.when(~F.col("needs_address_lookup"), F.col("ho")).alias("ho"), "property_type", "is_target", "needs_unit", "building_name",
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "used_query", "price_last", "price_this",
        (F.col("price_this") - F.col("price_last")).alias("price_delta"), "price_calc", "confidence_score", "confidence_grade",
        C.needs_manual_check(F.col("confidence_grade")).alias("needs_manual_check"),
        C.status(
            F.col("all_warnings"), F.col("ambiguous"), F.col("needs_unit"), F.col("ok"), F.col("price_this"), F.col("price_last"),
            F.col("property_type"), F.col("is_target"),
        ).alias("status"),
        C.checks(F.col("pnu"), F.col("needs_unit"), F.col("price_this"), F.col("price_last"), F.col("input_type")).alias("checks"),
        F.col("all_warnings").alias("warnings"),
    )


def resolve_parcels(requests: DataFrame, sources: Sources) -> DataFrame:
    """Requests with their parcel key; only those without a given key walk the address ladder.

    The parsed requests are stored first: the ladder parses the search texts once more, and building
    on a stored column keeps both parses small.
    """
    rows = stored(with_query(route(requests, sources.register)), "routed", measured=True)
    open_rows = rows.where(F.col("asked_pnu").isNull() & F.col("query").isNotNull()).select("request_id", "query")
    found = geocode.resolve(open_rows, sources.primary, sources.secondary)
    joined = rows.join(found, "request_id", "left")
    asked = F.col("asked_pnu").isNotNull() & F.col("query").isNotNull()
    return joined.withColumn("pnu", F.when(asked, F.col("asked_pnu")).otherwise(F.col("geo_pnu"))).withColumn(
        "refined_address", F.when(asked, F.nullif("q", F.lit(""))).otherwise(F.col("geo_address"))
    )


def lookup(requests: DataFrame, sources: Sources, this_year: str, last_year: str) -> DataFrame:
    """The whole job.  Stage tables cut the plan: parsed requests, resolved requests, both matches, and the answers.

    The lists of keys that requests and units are exploded to are many times the size Spark expects, so all joins go by measured sizes.
    """
    resolved = stored(resolve_parcels(requests, sources), "resolved", measured=True)
    asked = resolved.where(F.col("pnu").isNotNull()).select("request_id", "pnu", "dong", "ho")
    matched = stored(units.attach_last_year(units.match_units(asked, sources.units, this_year), sources.units, last_year), "matched", measured=True)
    expected = sources.expected
    if expected is not None and "year" in expected.columns:
        expected = expected.where(F.col("year") == this_year)
    explained = units.explain_missing(matched, sources.units, this_year, expected)
    if sources.errors is not None:
        explained = units.name_errors(explained, sources.errors, this_year, last_year)
    apt = explained.select("request_id", F.struct("unit", "single", "sample", "price", "needs_unit", "warnings", "price_last", "warnings_last").alias("apt"))
    office = officetel.attach_last_year(officetel.match_officetel(asked, sources.officetel, this_year), sources.officetel, last_year)
    ofc = office.select("request_id", F.struct("unit", "sample", "is_matched", "price", "needs_unit", "warnings", "price_last", "warnings_last").alias("ofc"))
    return stored(score_and_status(choose(resolved.join(apt, "request_id", "left").join(ofc, "request_id", "left"))), "answers", measured=True)


def refine(requests: DataFrame, sources: Sources) -> DataFrame:
    """Address refinement alone: type, both addresses, parcel key and parts, tier, ambiguity."""
    rows = route(requests)
    p = F.col("parsed")
    is_number = F.col("register_number").isNotNull()
    rows = rows.withColumn("query", F.when(~is_number, F.coalesce(F.nullif(A.search_query(p), F.lit("")), F.col("q"))))
    kind = F.when(is_number, F.col("input_type")).when(p["is_road"], "도로명주소").when(p["main_lot"].isNotNull(), "지번주소").otherwise(F.col("input_type"))
    rows = stored(rows.select("request_id", "q", kind.alias("input_type"), p["building_dong"].alias("dong"), p["ho"].alias("ho"), "query"), "routed")
    found = geocode.resolve(rows.where(F.col("query") != "").select("request_id", "query"), sources.primary, sources.secondary)
    joined = rows.join(found, "request_id", "left")
    tail = (
        F.when(is_number_text(), F.array(F.lit("등기고유번호는 주소 정제 대상이 아님(보증DB 역조회 필요)")))
        .when(F.col("ambiguous"), F.array(F.lit("상위 행정구역(시/도·시군구)을 함께 입력하면 정확해져요")))
        .when(~F.col("geo_ok"), F.array(F.lit("정제 실패 - 주소를 찾지 못함")))
        .otherwise(_no_text())
    )
    return joined.select(
        "request_id", "q", F.coalesce("geo_ok", F.lit(False)).alias("ok"), "input_type", "road_address", F.col("geo_address").alias("jibun_address"),
        F.col("geo_pnu").alias("pnu"), K.split_pnu(F.col("geo_pnu")).alias("pnu_parts"), "is_apartment",
        F.when(~is_number_text(), F.col("dong")).alias("dong"), F.when(~is_number_text(), F.col("ho")).alias("ho"),
        F.coalesce("geo_tier", F.lit(0)).alias("tier"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "used_query",
        F.concat(F.coalesce("geo_warnings", _no_text()), F.coalesce(tail, _no_text())).alias("warnings"),
    )


def is_number_text() -> Column:
    return K.is_register_number(F.col("q"))

"""Address to parcel: candidate grouping and the fallback ladder over landed search results.

``primary``: query, pos, adm_code, mountain, main_lot, sub_lot, sido, sigungu, emd, lot_address,
road_address, building_kind, history, error.  ``secondary``: query, pos, adm_code, mountain,
main_lot, sub_lot, address_name, has_address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import keys as K

# How many regions a message names, how many words may be cut, shortest query.
REGIONS_NAMED = 5
WORDS_CUT = 2
SHORTEST_QUERY = 4


def parcel_groups(primary: DataFrame) -> DataFrame:
    """One row per (query, parcel): the first candidate of every parcel represents it.

    Two spellings of one parcel collapse, two lots of one dong stay apart.  Codes shorter than ten
    characters are dropped.
    """
    code = F.substring("adm_code", 1, 10)
    lot = lambda name: F.lpad(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("0")), 4, "0")
    keyed = primary.where(F.length("adm_code") >= 10).withColumn(
        "key", F.concat(code, K.mountain_flag(F.col("mountain"), "juso"), lot("main_lot"), lot("sub_lot"))
    )
    item = F.struct(
        "pos", "adm_code", "mountain", "main_lot", "sub_lot", "sido", "sigungu", "emd", "lot_address", "road_address", "building_kind", "history"
    )
    return keyed.groupBy("query", "key").agg(F.min(item).alias("item"))


def region_candidates(groups: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidate parcels of the given (ambiguous) queries, one row each, with the key to look up next."""
    wanted = queries.select("query").distinct()
    return groups.join(wanted, "query", "left_semi").select(
        "query", F.col("item.pos").alias("pos"), F.col("key").alias("pnu"), F.substring("key", 1, 10).alias("pnu_prefix"),
        "item.sido", "item.sigungu", "item.emd", F.coalesce("item.road_address", "item.lot_address").alias("address"),
    )


def primary_results(primary: DataFrame) -> DataFrame:
    """Outcome of every query at the first provider: resolved, ambiguous or nothing, with warnings."""
    groups = parcel_groups(primary)
    ranked = groups.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("item.pos", "key")))
    named = ranked.where(F.col("_r") <= REGIONS_NAMED).groupBy("query").agg(
        F.min(F.struct("item.pos", "key", "item")).alias("first"),
        F.sort_array(F.collect_list(F.struct("_r", F.concat_ws(" ", "item.sido", "item.sigungu", "item.emd").alias("name")))).alias("names"),
    )
    counted = groups.groupBy("query").agg(F.count(F.lit(1)).alias("regions"))
    answered = primary.groupBy("query").agg(
        F.max("error").alias("error"), F.count(F.when(F.col("error").isNull() & F.col("pos").isNotNull(), 1)).alias("candidates")
    )
    joined = answered.join(counted, "query", "left").join(named, "query", "left")
    clean = F.col("error").isNull()
    ok = clean & (F.col("regions") == 1)
    ambiguous = clean & (F.col("regions") > 1)
    item = F.col("first.item")
    warnings = F.array_compact(
        F.array(
            F.when(~clean, F.concat(F.lit("juso 오류: "), F.col("error"))),
            F.when(clean & F.col("regions").isNull(), F.lit("juso 결과 없음")),
            F.when(
                ambiguous,
                F.concat(
                    F.lit("동명이지 "), F.col("regions").cast("string"), F.lit("곳 매칭("),
                    F.array_join(F.transform("names", lambda n: n["name"]), " / "), F.lit(") - 상위 행정구역 필요"),
                ),
            ),
            F.when(ok & (item["history"] == "1"), F.lit("변동이력 있는 주소(과거주소 가능)")),
        )
    )
    return joined.select(
        F.lit("primary").alias("provider"), "query", F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"),
        F.when(ok, K.build_pnu(item["adm_code"], item["main_lot"], item["sub_lot"], item["mountain"], "juso")).alias("pnu"),
        F.when(ok, K.pnu_problem(item["adm_code"], item["main_lot"], item["sub_lot"])).alias("problem"),
        F.when(ok, F.coalesce(item["lot_address"], item["road_address"])).alias("refined_address"),
        F.when(ok, item["road_address"]).alias("road_address"),
        F.when(ok, F.coalesce(item["building_kind"] == "1", F.lit(False))).alias("is_apartment"),
        F.col("candidates"), warnings.alias("warnings"),
    )


def secondary_results(secondary: DataFrame) -> DataFrame:
    """Outcome of every query at the second provider: its first document decides."""
    item = F.struct("pos", "adm_code", "mountain", "main_lot", "sub_lot", "address_name", "has_address")
    top = secondary.groupBy("query").agg(F.min(item).alias("item"), F.count(F.lit(1)).alias("candidates"))
    item = F.col("item")
    ok = F.coalesce(item["has_address"], F.lit(False))
    return top.select(
        F.lit("secondary").alias("provider"), "query", ok.alias("ok"), F.lit(False).alias("ambiguous"),
        F.when(ok, K.build_pnu(item["adm_code"], item["main_lot"], item["sub_lot"], item["mountain"], "kakao")).alias("pnu"),
        F.when(ok, K.pnu_problem(item["adm_code"], item["main_lot"], item["sub_lot"])).alias("problem"),
        F.when(ok, item["address_name"]).alias("refined_address"), F.lit(None).cast("string").alias("road_address"),
        F.lit(None).cast("boolean").alias("is_apartment"), F.col("candidates"),
        F.array_compact(F.array(F.when(~ok, F.lit("카카오 지번주소 없음")))).alias("warnings"),
    )


def _rungs(query: Column, stripped: Column, is_road: Column) -> Column:
    words = F.filter(F.split(stripped, r"\s+"), lambda w: w != "")

    def rung(number: int, provider: str, text: Column, when: Column | None = None) -> Column:
        value = F.struct(F.lit(number).alias("rung"), F.lit(provider).alias("provider"), text.alias("query"))
        return value if when is None else F.when(when, value)

    rungs = [
        rung(1, "primary", query),
        rung(2, "primary", stripped, (stripped != F.trim(query)) & (stripped != "")),
        rung(3, "secondary", query),
    ]
    long_enough = ~is_road
    for cut in range(1, WORDS_CUT + 1):
        shorter = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - cut, F.lit(0))), " ")
        long_enough = long_enough & (F.size(words) > cut) & (F.length(shorter) >= SHORTEST_QUERY)
        rungs.append(rung(3 + cut, "primary", shorter, long_enough))
    return F.array_compact(F.array(*rungs))


def resolve(requests: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Walk the ladder for every request (``request_id`` unique, ``query``).

    Rungs: the query, the query without unit details, the second provider, one and two words cut
    (never for road addresses).  The first rung that resolves or is ambiguous wins; warnings of the
    rungs before it are carried, those of failed cuts are not.  Each rung is an equality join on
    the query text against one row per query; a request has at most five rungs.
    """
    answers = primary_results(primary).unionByName(secondary_results(secondary))
    prepared = A.parse_address(requests.select("request_id", "query"), "query", "_p").withColumn("_stripped", A.strip_detail(F.col("query")))
    steps = prepared.select("request_id", F.explode(_rungs(F.col("query"), F.col("_stripped"), F.col("_p.is_road"))).alias("r")).select(
        "request_id", "r.rung", "r.provider", "r.query"
    )
    nothing = F.when(F.col("provider") == "primary", "juso 결과 없음").otherwise("카카오 결과 없음")
    joined = steps.join(answers, ["provider", "query"], "left")
    outcome = F.struct(
        "rung", "query", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "pnu", "problem",
        "refined_address", "road_address", "is_apartment", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce(F.col("warnings"), F.array(nothing)).alias("warnings"),
    )
    walked = joined.groupBy("request_id").agg(F.sort_array(F.collect_list(outcome)).alias("steps"))
    walked = walked.withColumn("win", F.get(F.filter("steps", lambda s: s["ok"] | s["ambiguous"]), F.lit(0)))
    until = F.coalesce(F.col("win.rung"), F.lit(99))
    tried = F.flatten(F.transform(F.filter("steps", lambda s: (s["rung"] < until) & (s["rung"] <= 3)), lambda s: s["warnings"]))
    cut_note = F.when(F.col("win.rung") > 3, F.array(F.concat(F.lit("절삭검색 적용('"), F.col("win.query"), F.lit("')")))).otherwise(
        F.array().cast("array<string>")
    )
    warnings = F.when(F.col("win").isNull(), F.concat(tried, F.array(F.lit("정제 실패 - 모든 폴백 소진")))).otherwise(
        F.concat(tried, cut_note, F.col("win.warnings"))
    )
    tier = F.when(~F.coalesce("win.ok", F.lit(False)), 0).when(F.col("win.rung") == 3, 2).otherwise(1)
    return walked.select(
        "request_id", F.coalesce("win.ok", F.lit(False)).alias("geo_ok"), F.coalesce("win.ambiguous", F.lit(False)).alias("ambiguous"),
        tier.alias("geo_tier"), F.col("win.rung").alias("rung"), F.col("win.query").alias("used_query"), F.col("win.pnu").alias("geo_pnu"),
        F.col("win.problem").alias("geo_problem"), F.col("win.refined_address").alias("geo_address"), F.col("win.road_address").alias("road_address"),
        F.col("win.is_apartment").alias("is_apartment"), F.coalesce(F.col("win.candidates"), F.col("steps")[0]["candidates"]).alias("candidates"),
        warnings.alias("geo_warnings"),
    )

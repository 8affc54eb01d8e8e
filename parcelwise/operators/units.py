"""Unit matching within a parcel, across two years, and suggestions for what was not found.

Requests: ``request_id`` (unique), ``pnu``, ``dong``, ``ho`` and any other columns.
Units: ``pnu, year, dong, floor, ho, price, name, type``.
No representative unit is ever guessed: a price is given only for exactly one unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import KEY_ERRORS
from ..functions.keys import unit_key, unit_token
from ..session import stored
from .keyed import Key, count_by_keys, count_lookup, of_parcels

# Fixed values of the output: how many labels a message lists.
DONGS_LISTED = 10
HOS_LISTED = 8
ELSEWHERE_LISTED = 6
NO_UNITS = "해당 PNU 공시가격 없음"


def _given(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) != ""


def _raw(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _unit_struct() -> Column:
    return F.struct("dong", "floor", "ho", "price", "name", "type")


def _identity() -> Column:
    """A number for a unit: equal for equal rows."""
    return F.xxhash64("pnu", "dong", "floor", "ho", "price", "name", "type")


def _wanted_parcels(requests: DataFrame) -> DataFrame:
    """One row per requested parcel with the forms of requests it gets."""
    return requests.where(F.col("pnu").isNotNull()).groupBy("pnu").agg(
        F.max(_given("dong") & _given("ho")).alias("_both"),
        F.max(~_given("dong") & _given("ho")).alias("_ho_only"),
        F.max(_given("dong") & ~_given("ho")).alias("_dong_only"),
    )


def match_units(requests: DataFrame, units: DataFrame, year: str) -> DataFrame:
    """Match every request to at most one unit of its parcel in one year.

    Tiers: 1 the raw spelling hits exactly one unit; 2 normalised tokens; 3 the unit number alone,
    only where no unit of the parcel has a building and tier 2 found nothing.

    Adds ``total``, ``candidates``, ``tier``, ``unit`` (the matched one), ``single`` (the only unit of
    the parcel when nothing matched), ``sample`` (a unit of the parcel), ``price``, ``needs_unit`` and
    ``warnings``.  :func:`explain_missing` adds why a named building or unit was not found.
    """
    # Read three times: for the keys, for the units they name, and for one unit of each parcel.
    of_year = stored(of_parcels(units.where(F.col("year") == year), _wanted_parcels(requests)), "asked-units", measured=True)
    blank, identity = F.lit(""), _identity()
    forms = of_year.select("pnu", "_both", "_ho_only", "_dong_only", identity.alias("_id"), _raw("dong").alias("_rd"), _raw("ho").alias("_rh"), unit_token(F.col("dong")).alias("_nd"), unit_token(F.col("ho")).alias("_nh"))
    c = F.col
    table = count_by_keys(
        forms,
        [
            Key("parcel", blank, blank),
            Key("built", blank, blank, c("_both") & (c("_nd") != "")),
            Key("raw2", c("_rd"), c("_rh"), c("_both")),
            Key("norm2", c("_nd"), c("_nh"), c("_both")),
            Key("raw_ho", blank, c("_rh"), c("_ho_only")),
            Key("norm_ho", blank, c("_nh"), c("_ho_only")),
            Key("raw_dong", c("_rd"), blank, c("_dong_only")),
            Key("norm_dong", c("_nd"), blank, c("_dong_only")),
        ],
        c("_id"),
    )
    asked = requests.select(
        "request_id", "pnu", _given("dong").alias("_gd"), _given("ho").alias("_gh"), _raw("dong").alias("_rd"), _raw("ho").alias("_rh"), unit_token(c("dong")).alias("_nd"), unit_token(c("ho")).alias("_nh"))
    both = c("_gd") & c("_gh")
    kind = F.when(both, "2").when(~c("_gd") & c("_gh"), "_ho").when(c("_gd") & ~c("_gh"), "_dong")
    part = lambda given, form: F.when(c(given), c(form)).otherwise("")
    counts = count_lookup(
        asked,
        {
            "parcel": Key("parcel", blank, blank),
            "built": Key("built", blank, blank, both),
            "raw": Key(F.concat(F.lit("raw"), kind), part("_gd", "_rd"), part("_gh", "_rh"), kind.isNotNull()),
            "norm": Key(F.concat(F.lit("norm"), kind), part("_gd", "_nd"), part("_gh", "_nh"), kind.isNotNull()),
            "no_dong": Key("norm2", blank, c("_nh"), both),
        },
        table,
    )
    # Stored, so that the files of the shuffles of all keys go before the units the keys name are joined.
    found = requests.join(stored(counts, "unit-counts", measured=True), "request_id", "left")
    count = lambda slot: F.coalesce(F.col(f"{slot}_n"), F.lit(0).cast("bigint"))
    tier = (
        F.when(count("raw") == 1, 1)
        .when(count("norm") > 0, 2)
        .when(_given("dong") & _given("ho") & (count("built") == 0) & (count("no_dong") > 0), 3)
    )
    found = found.withColumn("total", count("parcel")).withColumn("tier", tier)
    found = found.withColumn(
        "candidates",
        F.when(F.col("tier") == 1, F.lit(1).cast("bigint")).when(F.col("tier") == 2, count("norm")).when(F.col("tier") == 3, count("no_dong")).otherwise(F.lit(0).cast("bigint")),
    )
    one = F.col("candidates") == 1
    alone = (F.col("candidates") == 0) & (F.col("total") == 1)
    chosen = F.when(one, F.when(F.col("tier") == 1, F.col("raw_id")).when(F.col("tier") == 2, F.col("norm_id")).when(F.col("tier") == 3, F.col("no_dong_id"))).when(alone, F.col("parcel_id"))
    found = found.withColumn("_id", chosen).drop(*[f"{slot}_{x}" for slot in ("parcel", "built", "raw", "norm", "no_dong") for x in ("n", "id")])
    # The one unit that an identity names, and one of each parcel's units, come from the facts by plain keys.
    named = of_year.select("pnu", identity.alias("_id"), _unit_struct().alias("_unit"))
    named = named.join(found.where(F.col("_id").isNotNull()).select("pnu", "_id").distinct(), ["pnu", "_id"], "left_semi").groupBy("pnu", "_id").agg(F.min("_unit").alias("_unit"))
    samples = of_year.groupBy("pnu").agg(F.min(_unit_struct()).alias("sample"))
    found = found.join(named, ["pnu", "_id"], "left").join(samples, "pnu", "left")
    found = found.withColumn("unit", F.when(one, F.col("_unit"))).withColumn("single", F.when(alone, F.col("_unit")))
    found = found.withColumn("price", F.coalesce(F.col("unit"), F.col("single"))["price"]).withColumn(
        "needs_unit", (F.col("total") > 0) & F.col("unit").isNull() & F.col("single").isNull()
    )
    return found.withColumn("warnings", _match_warnings()).select(
        *requests.columns, "total", "candidates", "tier", "unit", "single", "sample", "price", "needs_unit", "warnings"
    )


def _top_labels(pairs: DataFrame, keys: list[str], label: str, limit: int, prefix: str) -> DataFrame:
    """Distinct labels per key: their number and the first few in text order.

    The ranking filter is pushed below the shuffle, so a key with very many labels stays cheap.
    """
    distinct = pairs.select(*keys, label).distinct()
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(label))).where(F.col("_r") <= limit)
    first = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(label)).alias(f"{prefix}_list"))
    return distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}_count")).join(first, keys)


def explain_missing(matched: DataFrame, units: DataFrame, year: str, expected: DataFrame | None = None) -> DataFrame:
    """Prepend the reason to the warnings of requests whose building or unit is not there.

    Lists the buildings seen in the parcel, or the units of the asked building.  ``expected``
    (pnu, expected) holds announced totals, to report that not all units were received.
    ``matched`` is read twice, so hand in a stored table when it is expensive.
    """
    missing = (F.col("candidates") == 0) & (F.col("total") > 0) & _given("dong")
    parcels = matched.where(missing).select("pnu").distinct()
    pairs = of_parcels(units.where(F.col("year") == year), parcels).select(
        "pnu", unit_token(F.col("dong")).alias("_nd"), unit_token(F.col("ho")).alias("_nh")
    ).distinct()
    dongs = _top_labels(pairs.where("_nd <> ''"), ["pnu"], "_nd", DONGS_LISTED, "_dongs")
    hos = _top_labels(pairs, ["pnu", "_nd"], "_nh", HOS_LISTED, "_hos")
    keyed = matched.withColumn("_missing", missing).withColumn("_nd", F.when(missing, unit_token(F.col("dong"))))
    joined = keyed.join(dongs, "pnu", "left").join(hos, ["pnu", "_nd"], "left")
    if expected is not None:
        joined = joined.join(expected.groupBy("pnu").agg(F.max("expected").alias("_expected")), "pnu", "left")
    else:
        joined = joined.withColumn("_expected", F.lit(None).cast("bigint"))
    total, ho, dong = F.col("total").cast("string"), F.trim("ho"), F.trim("dong")
    dongs_count = F.coalesce(F.col("_dongs_count"), F.lit(0))
    dong_seen = F.col("_hos_count").isNotNull() & (F.col("_nd") != "")
    reasons = F.array(
        F.when(
            F.col("_missing") & ~dong_seen,
            F.concat(
                F.lit("입력한 "), dong, F.lit("동이 조회된 세대에 없어요 (조회된 동 "), dongs_count.cast("string"), F.lit("개: "),
                F.coalesce(F.array_join("_dongs_list", ", "), F.lit("")),
                F.when(dongs_count > DONGS_LISTED, "…").otherwise(""), F.lit(")"),
            ),
        ),
        F.when(
            F.col("_missing") & dong_seen,
            F.concat(
                dong, F.lit("동에 "), F.coalesce(ho, F.lit("")), F.lit("호가 없어요 ("), dong, F.lit("동 "),
                F.col("_hos_count").cast("string"), F.lit("세대: "), F.array_join("_hos_list", ", "), F.lit("…)"),
            ),
        ),
        F.when(
            F.col("_missing") & (F.col("total") < F.col("_expected")),
            F.concat(
                F.lit("★세대 일부만 조회됨: "), total, F.lit("/"), F.col("_expected").cast("string"),
                F.lit("건 — 페이지 수신 누락 (이 때문에 못 찾았을 수 있어요)"),
            ),
        ),
    )
    return joined.withColumn("warnings", F.concat(F.array_compact(reasons), F.col("warnings"))).select(*matched.columns)


def _match_warnings() -> Column:
    total, ho = F.col("total").cast("string"), F.trim("ho")
    only = F.col("single.ho")
    nothing_given = ~(_given("dong") | _given("ho"))
    unresolved = F.col("needs_unit") & (F.col("candidates") == 0)
    return F.array_compact(
        F.array(
            F.when(F.col("total") == 0, F.lit(NO_UNITS)),
            F.when(F.col("tier") == 3, F.lit("공시가 데이터에 동 구분이 없어 호로만 특정")),
            F.when(
                F.col("candidates") > 1,
                F.concat(F.lit("같은 호가 여러 동에 있음("), F.col("candidates").cast("string"), F.lit("건) - 동을 입력해야 특정 가능")),
            ),
            F.when(
                F.col("single").isNotNull() & _given("ho") & (unit_token(only) != "") & (unit_token(only) != unit_token(F.col("ho"))),
                F.concat(F.lit("입력 호("), ho, F.lit(")와 자료상 호("), only, F.lit(")가 달라요 - 확인 필요")),
            ),
            F.when(unresolved & ~nothing_given, F.concat(F.lit("동/호 미매칭 - 세대 "), total, F.lit("건 중 특정 실패(동·호 확인 필요)"))),
            F.when(unresolved & nothing_given, F.concat(F.lit("세대 "), total, F.lit("건 - 동·호를 입력해야 특정 가능"))),
        )
    )


def attach_last_year(matched: DataFrame, units: DataFrame, last_year: str) -> DataFrame:
    """Last year's price of the unit pinned this year, through its dong|floor|ho key.

    Accepted only when exactly one unit has that key.  Adds ``price_last`` and ``warnings_last``.

    ``matched`` is read three times, so it is stored; the files of the shuffles behind it go before those of last year are written.
    """
    matched = stored(matched, "matched-units", measured=True)
    anchor = F.coalesce(F.col("unit"), F.when(F.col("single.price").isNotNull(), F.col("single")))
    keyed = matched.select("request_id", "pnu", unit_key(anchor["dong"], anchor["floor"], anchor["ho"]).alias("_key"), anchor.isNotNull().alias("_anchored"))
    parcels = keyed.where(F.col("pnu").isNotNull()).select("pnu").distinct()
    of_year = of_parcels(units.where(F.col("year") == last_year), parcels)
    blank = F.lit("")
    # Where a key has one unit, the smallest price is that unit's price.
    table = count_by_keys(of_year, [Key("parcel", blank, blank), Key("unit", unit_key(F.col("dong"), F.col("floor"), F.col("ho")), blank)], F.col("price"))
    found = count_lookup(keyed, {"parcel": Key("parcel", blank, blank), "same": Key("unit", F.col("_key"), blank, F.col("_anchored"))}, table)
    found = keyed.select("request_id").join(stored(found, "last-counts", measured=True), "request_id", "left")
    total, same = F.coalesce(F.col("parcel_n"), F.lit(0).cast("bigint")), F.coalesce(F.col("same_n"), F.lit(0).cast("bigint"))
    last = found.select("request_id", total.alias("total_last"), same.alias("_same"), F.when(same == 1, F.col("same_id")).alias("price_last"))
    joined = matched.join(last, "request_id", "left")
    note = F.lit("전년도에서 동일 세대를 확인하지 못해 비교 생략")
    suffix = (
        F.when(F.col("unit").isNull(), F.lit(""))
        .when(F.col("_same") > 0, F.concat(F.lit("(동일키 "), F.col("_same").cast("string"), F.lit("건)")))
        .otherwise(F.lit("(해당 세대 없음)"))
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("total_last") == 0, F.lit(NO_UNITS)),
            F.when(F.col("total_last") > 1, F.concat(F.lit("세대 "), F.col("total_last").cast("string"), F.lit("건 - 동·호를 입력해야 특정 가능"))),
            F.when(anchor.isNotNull() & (F.col("_same") != 1), F.concat(note, suffix)),
        )
    )
    return joined.withColumn("warnings_last", warnings).drop("_same")


def name_errors(matched: DataFrame, errors: DataFrame, this_year: str, last_year: str) -> DataFrame:
    """Say which error left a parcel without units, in place of the warning that it has none.

    ``errors`` holds (pnu, year, error_code), ``matched`` the warnings of both years.  Parcels with units keep theirs.
    """
    by_parcel = errors.where(F.col("year").isin(this_year, last_year) & F.col("pnu").isNotNull()).groupBy("pnu").agg(
        F.min(F.when(F.col("year") == this_year, F.col("error_code"))).alias("_error"),
        F.min(F.when(F.col("year") == last_year, F.col("error_code"))).alias("_error_last"),
    )

    def named(warnings: str, error: str) -> Column:
        code = F.col(error)
        text = F.concat(F.when(code.isin(*KEY_ERRORS), "인증 오류: ").otherwise("API 오류: "), code)
        return F.when(code.isNull(), F.col(warnings)).otherwise(F.transform(warnings, lambda w: F.when(w == NO_UNITS, text).otherwise(w)))

    joined = matched.join(by_parcel, "pnu", "left")
    return joined.withColumns({"warnings": named("warnings", "_error"), "warnings_last": named("warnings_last", "_error_last")}).select(*matched.columns)


def available_units(requests: DataFrame, units: DataFrame, year: str) -> DataFrame:
    """Distinct (dong, ho) labels of every parcel that still needs a unit, with their natural rank keys.

    One row per label instead of an array per request: a large complex asked for by many requests
    would otherwise be repeated for each of them.
    """
    parcels = requests.where("needs_unit").select("pnu").distinct()
    labels = of_parcels(units.where(F.col("year") == year), parcels)
    return labels.select("pnu", F.trim(_raw("dong")).alias("dong"), F.trim(_raw("ho")).alias("ho")).distinct()


def suggest_elsewhere(requests: DataFrame, units: DataFrame, year: str) -> DataFrame:
    """Other buildings that have the asked unit number, for requests whose building lacks it."""
    asked = requests.where(F.col("candidates") == 0).where(_given("dong") & _given("ho") & (F.col("total") > 0))
    asked = asked.select("request_id", "pnu", F.trim("ho").alias("ho"))
    keys = asked.select("pnu", "ho").distinct()
    labels = units.where(F.col("year") == year).select("pnu", F.trim(_raw("ho")).alias("ho"), F.trim(_raw("dong")).alias("_d")).where("_d <> ''")
    pairs = labels.join(keys, ["pnu", "ho"], "left_semi")
    listed = _top_labels(pairs, ["pnu", "ho"], "_d", ELSEWHERE_LISTED, "elsewhere")
    return asked.join(listed, ["pnu", "ho"]).select("request_id", "elsewhere_count", "elsewhere_list")


def _prefixes(label: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(label)), lambda n: F.substring(label, F.lit(1), n))


def browse_units(requests: DataFrame, units: DataFrame, year: str) -> DataFrame:
    """What is left of a parcel's units after a building and a unit prefix have been typed.

    ``dong_matches``: buildings starting with the typed text.  ``ho_matches``: units starting with the
    typed number inside the exactly named building, or in the whole parcel when it has no buildings.
    Labels are short, so every label is expanded to its prefixes and the join stays an equality.
    """
    asked = requests.select(
        "request_id", "pnu", F.coalesce(F.trim("dong"), F.lit("")).alias("d"), F.coalesce(F.trim("ho"), F.lit("")).alias("h")
    )
    parcels = asked.where(F.col("pnu").isNotNull()).select("pnu").distinct()
    labels = of_parcels(units.where(F.col("year") == year), parcels).select(
        "pnu", F.trim(_raw("dong")).alias("d"), F.trim(_raw("ho")).alias("u")
    ).distinct()
    dongs = labels.where("d <> ''").select("pnu", "d").distinct()
    by_dong = dongs.select("pnu", F.explode(_prefixes(F.col("d"))).alias("d")).groupBy("pnu", "d").agg(F.count(F.lit(1)).alias("dong_matches"))
    by_ho = labels.select("pnu", "d", F.explode(_prefixes(F.col("u"))).alias("h")).groupBy("pnu", "d", "h").agg(F.count(F.lit(1)).alias("ho_matches"))
    has_dong = labels.groupBy("pnu").agg(F.max(F.col("d") != "").alias("has_dong"))
    joined = asked.join(has_dong, "pnu", "left").join(by_dong, ["pnu", "d"], "left")
    pooled = joined.withColumn("d", F.when(F.col("has_dong"), F.when(F.col("d") != "", F.col("d"))).otherwise(F.lit("")))
    return pooled.join(by_ho, ["pnu", "d", "h"], "left").select(
        "request_id",
        F.coalesce("dong_matches", F.lit(0)).alias("dong_matches"),
        F.coalesce("ho_matches", F.lit(0)).alias("ho_matches"),
    )

"""Confidence score, status and checks of a lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of every signal, penalty, grade limits, warnings that cost nothing.
WEIGHTS = {"주소_정제_1차": 40, "주소_정제_폴백": 22, "지번_확인": 15, "호_확인": 28, "등기_교차검증": 17}
PENALTY = 3
GRADES = (("A", 85), ("B", 65), ("C", 40))
BENIGN = ("도로명주소", "호 미인식", "읍면동 미인식", "지번 미인식", "호로만 특정", "동 구분이 없어")
KEY_ERRORS = ("INVALID_KEY", "INCORRECT_KEY", "UNAVAILABLE_KEY", "OVER_REQUEST_LIMIT")


def _yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def signals(tier: Column, has_lot: Column, has_ho: Column, registered: Column) -> Column:
    """Map of the signals that hold."""
    flags = {
        "주소_정제_1차": tier == 1, "주소_정제_폴백": tier == 2, "지번_확인": has_lot, "호_확인": has_ho, "등기_교차검증": registered,
    }
    return F.map_from_entries(
        F.array_compact(F.array(*[F.when(_yes(flag), F.struct(F.lit(name).alias("k"), F.lit(True).alias("v"))) for name, flag in flags.items()]))
    )


def notes(tier: Column, has_ho: Column, warnings: Column) -> Column:
    own = F.array_compact(
        F.array(
            F.when(tier == 2, F.lit("1차 정제 실패 → 폴백 엔진으로 확보")),
            F.when(~_yes(has_ho), F.lit("호 미확정 → 단지/동 단위까지만 식별됨")),
        )
    )
    return F.concat(own, F.array_distinct(warnings))


def score(tier: Column, has_lot: Column, has_ho: Column, registered: Column, warnings: Column) -> Column:
    """0..100: weights of the signals less three points per distinct warning that is not benign."""
    points = F.lit(0)
    for flag, name in (
        (tier == 1, "주소_정제_1차"), (tier == 2, "주소_정제_폴백"), (has_lot, "지번_확인"), (has_ho, "호_확인"), (registered, "등기_교차검증"),
    ):
        points = points + F.when(_yes(flag), WEIGHTS[name]).otherwise(0)
    serious = F.filter(F.array_distinct(warnings), lambda w: ~w.rlike("|".join(BENIGN)))
    return F.greatest(F.lit(0), F.least(F.lit(100), points - F.size(serious) * PENALTY)).cast("int")


def grade(points: Column) -> Column:
    chain = F.when(points.isNull(), F.lit("F"))
    for name, limit in GRADES:
        chain = chain.when(points >= limit, F.lit(name))
    return chain.otherwise(F.lit("F"))


def needs_manual_check(grade_name: Column) -> Column:
    return grade_name.isin("C", "F")


def status(
    warnings: Column, ambiguous: Column, needs_unit: Column, ok: Column, price_this: Column, price_last: Column,
    property_type: Column, is_target: Column,
) -> Column:
    source_error = F.exists(warnings, lambda w: w.rlike("인증|INCORRECT_KEY|INVALID_KEY"))
    return (
        F.when(source_error, "SOURCE_ERROR")
        .when(_yes(ambiguous), "NEEDS_ADDRESS_SELECTION")
        .when(_yes(needs_unit), "NEEDS_UNIT_SELECTION")
        .when(_yes(ok) & price_this.isNotNull() & price_last.isNotNull(), "SUCCESS")
        .when(_yes(ok) & price_this.isNotNull(), "SUCCESS_CURRENT_ONLY")
        .when(property_type.isNotNull() & ~F.coalesce(is_target, F.lit(True)), "UNSUPPORTED")
        .otherwise("NOT_FOUND")
    )


def checks(pnu: Column, needs_unit: Column, price_this: Column, price_last: Column, input_type: Column) -> Column:
    """The five verification steps with PASS, FAIL, SKIP or UNKNOWN."""

    def step(key: str, label: str, state: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), state.alias("state"))

    known = price_this.isNotNull()
    return F.array(
        step("address", "주소 확인", F.when(pnu.isNotNull(), "PASS").otherwise("FAIL")),
        step("unit", "세대 확인", F.when(_yes(needs_unit), "FAIL").when(known, "PASS").otherwise("UNKNOWN")),
        step("price", "가격 확인", F.when(known, "PASS").otherwise("FAIL")),
        step("compare", "전년도 비교", F.when(price_last.isNotNull(), "PASS").when(known, "UNKNOWN").otherwise("SKIP")),
        step("registry", "등기 교차확인", F.when(input_type == "등기고유번호", "PASS").otherwise("SKIP")),
    )


def delta(price_last: Column, price_this: Column) -> Column:
    """Change from last year to this year; percent and direction only when both are known."""
    change = price_this - price_last
    return F.struct(
        change.alias("delta"),
        F.when(price_last != 0, change / price_last * 100).alias("percent"),
        F.when(change >= 0, "up").when(change < 0, "down").alias("direction"),
    )

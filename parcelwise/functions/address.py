"""Bulk parsing of Korean lot and road addresses with built-in text functions.

``parse_address`` is a chain of rewrites in which every stage refers to the one before exactly once,
so the expressions stay small even where the optimizer inlines them into a pushed-down filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keys as K

# Province abbreviations and official names.
PROVINCES = {
    "서울": "서울특별시", "부산": "부산광역시", "대구": "대구광역시", "인천": "인천광역시", "광주": "광주광역시",
    "대전": "대전광역시", "울산": "울산광역시", "세종": "세종특별자치시", "경기": "경기도", "강원": "강원특별자치도",
    "충북": "충청북도", "충남": "충청남도", "전북": "전북특별자치도", "전남": "전라남도", "경북": "경상북도",
    "경남": "경상남도", "제주": "제주특별자치도",
}

# Patterns of the address parts.
UNIT = r"제?\s*([A-Za-z]?[0-9]{1,4}(?:-[0-9]{1,4})?)\s*호"
FLOOR = r"(지하\s*[0-9]+|[Bb][0-9]+|제?\s*[0-9]+)\s*층"
LOT = r"(산)?\s*([0-9]{1,4})(?:-([0-9]{1,4}))?"
ROAD = r"(\S*(?:로|길))\s+([0-9]+(?:-[0-9]+)?)"
SPACED_ROAD = r"(\S*로)\s+([0-9]+)\s*길"
BUILDING = r"제?\s*([0-9]{1,4})\s*동"
EXTRA_LOTS = r"외\s*[0-9]+\s*필지"
ROAD_HINT = r"(로|길)\s*[0-9]"
DETAIL_TAIL = r"\s*(제?\s*[0-9]+\s*동)?\s*(제?\s*[B]?[0-9]+\s*층)?\s*(제?\s*[0-9A-Za-z\-]+\s*호)\s*$"

FIELDS = ("sido", "sigungu", "emd", "mountain", "main_lot", "sub_lot", "building", "building_dong", "building_no", "floor", "ho", "is_road", "warnings")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s 　]+", " "))


def _group(text: Column, pattern: str, index: int) -> Column:
    """Group of the first match; an empty group counts as absent."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def _without_first(text: Column, pattern: str, between: str = "") -> Column:
    """Text with the first match cut out; unchanged without a match."""
    quiet = pattern.replace("(?:", "\0").replace("(", "(?:").replace("\0", "(?:")
    return F.regexp_replace(text, f"^(.*?)(?:{quiet})(.*)$", f"$1{between}$2")


_PROVINCE = "^(" + "|".join([*PROVINCES.values(), *PROVINCES]) + ")(?: |$)"
_DISTRICT = r"^(\S*[시군구](?: \S*구(?= |$))?)(?: |$)"
_DONG = r"^(\S*[동읍면가리])(?: |$)"
_FIRST_LOT = f"^.*?{LOT}(.*)$"


def parse_address(df: DataFrame, source: str, target: str = "parsed") -> DataFrame:
    """Add a struct with the parts of the address in ``source`` (fields in :data:`FIELDS`)."""
    own = df.columns
    c = F.col
    full_names = F.create_map(*[F.lit(x) for short, full in PROVINCES.items() for x in (short, full)])

    df = df.withColumn("_s0", F.regexp_replace(squeeze(c(source)), SPACED_ROAD, "$1$2길"))
    df = df.withColumn("_s1", F.regexp_replace("_s0", EXTRA_LOTS, ""))
    df = df.withColumn("_s2", _without_first(c("_s1"), UNIT))
    df = df.withColumn("_s3", squeeze(_without_first(c("_s2"), FLOOR)))
    df = df.withColumn("_s4", F.regexp_replace("_s3", _PROVINCE, ""))
    df = df.withColumn("_s5", F.regexp_replace("_s4", _DISTRICT, ""))
    df = df.withColumn("_s6", F.regexp_replace("_s5", _DONG, ""))
    df = df.withColumn("_rest", F.trim(_without_first(c("_s6"), BUILDING, " ")))
    df = df.withColumns(
        {
            "_empty": c("_s0") == "",
            "_extra": c("_s0").rlike(EXTRA_LOTS),
            "_ho": _group(c("_s1"), UNIT, 1),
            "_floor": _group(c("_s2"), FLOOR, 1),
            "_first": _group(c("_s3"), _PROVINCE, 1),
            "_sgg": _group(c("_s4"), _DISTRICT, 1),
            "_emd": _group(c("_s5"), _DONG, 1),
            "_bdong": _group(c("_s6"), BUILDING, 1),
            "_road": _group(c("_rest"), ROAD, 1),
            "_bno": _group(c("_rest"), ROAD, 2),
            "_any_lot": _group(c("_rest"), _FIRST_LOT, 2),
        }
    )
    df = df.withColumns(
        {
            "_sido": F.when(c("_first").isNotNull(), F.coalesce(F.try_element_at(full_names, c("_first")), c("_first"))),
            "_is_emd": c("_emd").isNotNull(),
            "_is_road": c("_bno").isNotNull(),
        }
    )
    df = df.withColumn("_main", F.when(~c("_is_road"), c("_any_lot"))).withColumn("_has_lot", c("_main").isNotNull())
    lot = _FIRST_LOT
    df = df.withColumn("_tail", F.when(c("_has_lot"), F.nullif(F.trim(F.regexp_extract("_rest", lot, 4), F.lit(" .,번지호")), F.lit(""))))
    warnings = F.when(c("_empty"), F.array(F.lit("빈 입력"))).otherwise(
        F.array_compact(
            F.array(
                F.when(c("_extra"), F.lit("복수필지(외 N필지) - 대표필지로 처리됨")),
                F.when(c("_ho").isNull(), F.lit("호 미인식")),
                F.when(~c("_is_emd"), F.lit("읍면동 미인식")),
                F.when(c("_is_road"), F.lit("도로명주소 - 지번은 juso 정제 필요")),
                F.when(~c("_is_road") & ~c("_has_lot"), F.lit("지번 미인식")),
            )
        )
    )
    parsed = F.struct(
        c("_sido").alias("sido"),
        c("_sgg").alias("sigungu"),
        c("_emd").alias("emd"),
        F.when(c("_has_lot") & (F.regexp_extract("_rest", lot, 1) == "산"), "1").otherwise("0").alias("mountain"),
        c("_main").alias("main_lot"),
        F.when(c("_has_lot"), F.coalesce(_group(c("_rest"), lot, 3), F.lit("0"))).alias("sub_lot"),
        F.when(c("_is_road"), c("_road")).otherwise(c("_tail")).alias("building"),
        c("_bdong").alias("building_dong"),
        F.when(c("_is_road"), c("_bno")).alias("building_no"),
        F.translate("_floor", " ", "").alias("floor"),
        c("_ho").alias("ho"),
        c("_is_road").alias("is_road"),
        warnings.alias("warnings"),
    )
    return df.select(*own, parsed.alias(target))


def lot_number(parsed: Column) -> Column:
    """'86-15', or '86' without a sub lot."""
    sub = parsed["sub_lot"]
    return F.when(sub.isNull() | (sub == "0"), parsed["main_lot"]).otherwise(F.concat_ws("-", parsed["main_lot"], sub))


def lot_address(parsed: Column) -> Column:
    mountain = F.when(parsed["mountain"] == "1", F.lit("산"))
    lot = F.when(parsed["main_lot"].isNotNull(), F.concat_ws(" ", mountain, lot_number(parsed)))
    return F.concat_ws(" ", parsed["sido"], parsed["sigungu"], parsed["emd"], lot)


def search_query(parsed: Column) -> Column:
    """Best search text: road name and number for road addresses, the lot address otherwise."""
    road = F.concat_ws(" ", parsed["sido"], parsed["sigungu"], parsed["building"], parsed["building_no"])
    return F.when(parsed["is_road"], road).otherwise(lot_address(parsed))


def input_class(text: Column, parsed: Column) -> Column:
    """Kind of request text; null for a blank one."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(raw == "", F.lit(None).cast("string"))
        .when(K.is_register_number(raw), F.lit("등기고유번호"))
        .when(raw.rlike(ROAD_HINT), F.lit("도로명주소"))
        .when(parsed["ho"].isNotNull() | parsed["building"].isNotNull(), F.lit("등기부주소"))
        .otherwise(F.lit("지번주소"))
    )


def strip_unit_tail(text: Column, dong: Column, ho: Column) -> Column:
    """Free text without a unit and a building label at its end."""

    def cut(value: Column, suffix: Column) -> Column:
        return F.trim(F.substring(value, F.lit(1), F.length(value) - F.length(suffix)))

    result = squeeze(text)
    for label in (ho, dong):
        name = F.trim(label)
        chain = F.when(F.coalesce(name, F.lit("")) == "", result)
        for unit in ("호", "동", ""):
            suffix = F.concat(name, F.lit(unit))
            chain = chain.when(F.endswith(result, suffix), cut(result, suffix))
        result = chain.otherwise(result)
    return result


def strip_detail(query: Column) -> Column:
    """Query without a trailing building, floor and unit."""
    return F.trim(F.regexp_replace(query, DETAIL_TAIL, ""))

"""Office units: prices per square metre, matched by unit number only; keyed load of yearly files.

Table: ``pnu, ldcode, building, dong, floor, ho, prvuse, share, price, year``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import unit_key, unit_token
from .keyed import Key, aggregate_by_keys, lookup, of_parcels

COLUMNS = ["pnu", "ldcode", "building", "dong", "floor", "ho", "prvuse", "share", "price", "year"]
KEY = ["pnu", "building", "dong", "floor", "ho", "year"]


def total_price(price: Column, prvuse: Column, share: Column) -> Column:
    """Unit price times exclusive plus shared area, rounded half to even; null when unknown."""
    return F.bround(price.cast("double") * (prvuse + F.coalesce(share, F.lit(0.0)))).cast("bigint")


def calc_area(prvuse: Column, share: Column) -> Column:
    return F.bround(prvuse + F.coalesce(share, F.lit(0.0)), 2)


def price_basis(unit: Column) -> Column:
    """How a total was computed."""
    return F.struct(
        unit["price"].alias("unit_price_per_m2"),
        unit["prvuse"].alias("exclusive_area_m2"),
        unit["share"].alias("share_area_m2"),
        calc_area(unit["prvuse"], unit["share"]).alias("total_area_m2"),
        F.lit("㎡당 기준시가 × (전용면적 + 공유면적)").alias("formula"),
        F.lit("NTS").alias("source"),
    )


def _unit_struct() -> Column:
    return F.struct("building", "dong", "floor", "ho", "price", "prvuse", "share")


def _total(unit: Column) -> Column:
    return total_price(unit["price"], unit["prvuse"], unit["share"])


def match_officetel(requests: DataFrame, officetel: DataFrame, year: str) -> DataFrame:
    """Match requests by unit number alone, first unit in (building, dong, floor, ho) order.

    A unit number that does not exist gives neither a price nor a demand for a choice; without a
    number only a parcel with a single unit has a price.  Adds ``total``, ``unit``, ``price``,
    ``needs_unit``, ``warnings``.
    """
    blank = F.lit("")
    given = F.coalesce(F.trim("ho"), F.lit("")) != ""
    parcels = requests.where(F.col("pnu").isNotNull()).select("pnu").distinct()
    of_year = of_parcels(officetel.where(F.col("year") == year), parcels)
    table = aggregate_by_keys(of_year, [Key("parcel", blank, blank), Key("ho", unit_token(F.col("ho")), blank)], _unit_struct())
    found = lookup(requests, {"parcel": Key("parcel", blank, blank), "hit": Key("ho", unit_token(F.col("ho")), blank, given)}, table)
    total = F.coalesce(F.col("parcel.n"), F.lit(0))
    found = found.withColumn("total", total).withColumn("matched", F.when(given, F.col("hit.unit")))
    found = found.withColumn("single", F.when(~given & (F.col("total") == 1), F.col("parcel.unit")))
    found = found.withColumn("unit", F.coalesce("matched", "single")).withColumn("sample", F.col("parcel.unit"))
    found = found.withColumn("price", _total(F.col("unit"))).withColumn("needs_unit", ~given & (F.col("total") > 1))
    text = F.col("total").cast("string")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("total") == 0, F.lit("해당 PNU 오피스텔 없음")),
            F.when(
                given & (F.col("total") > 0) & F.col("matched").isNull(),
                F.concat(F.lit("호 '"), F.trim("ho"), F.lit("' 미매칭 - 해당 호 없음(후보 "), text, F.lit("건)")),
            ),
            F.when(F.col("needs_unit"), F.concat(F.lit("호 "), text, F.lit("건 - 호를 입력해야 특정 가능"))),
        )
    )
    return found.withColumn("warnings", warnings).select(
        *requests.columns, "total", "unit", F.col("matched").isNotNull().alias("is_matched"), "sample", "price", "needs_unit", "warnings"
    )


def attach_last_year(matched: DataFrame, officetel: DataFrame, last_year: str) -> DataFrame:
    """Last year's total of the same unit, accepted only when its key is unique."""
    anchored = F.col("is_matched") | (F.col("unit").isNotNull() & F.col("price").isNotNull())
    key = unit_key(F.col("unit.dong"), F.col("unit.floor"), F.col("unit.ho"))
    keyed = matched.select("request_id", "pnu", key.alias("_key"), anchored.alias("_anchored"))
    parcels = keyed.where(F.col("pnu").isNotNull()).select("pnu").distinct()
    of_year = of_parcels(officetel.where(F.col("year") == last_year), parcels)
    blank = F.lit("")
    table = aggregate_by_keys(
        of_year, [Key("parcel", blank, blank), Key("unit", unit_key(F.col("dong"), F.col("floor"), F.col("ho")), blank)], _unit_struct()
    )
    found = lookup(keyed, {"parcel": Key("parcel", blank, blank), "same": Key("unit", F.col("_key"), blank, F.col("_anchored"))}, table)
    total, same = F.coalesce(F.col("parcel.n"), F.lit(0)), F.coalesce(F.col("same.n"), F.lit(0))
    last = found.select(
        "request_id",
        F.when(same == 1, _total(F.col("same.unit"))).alias("price_last"),
        F.array_compact(
            F.array(
                F.when(total == 0, F.lit("해당 PNU 오피스텔 없음")),
                F.when(total > 1, F.concat(F.lit("호 "), total.cast("string"), F.lit("건 - 호를 입력해야 특정 가능"))),
                F.when(F.col("_anchored") & (same != 1), F.lit("전년도에서 동일 세대를 확인하지 못해 비교 생략")),
            )
        ).alias("warnings_last"),
    )
    return matched.join(last, "request_id", "left")


def latest_per_key(loads: DataFrame, order: str = "load_seq") -> DataFrame:
    """Keyed upsert: of all loaded rows of one unit and year the last one wins.

    A max over a struct combines map-side, so many copies of one key stay cheap.  Missing label parts
    compare as empty text.
    """
    clean = loads.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("building", "dong", "floor", "ho")})
    rest = [c for c in COLUMNS if c not in KEY]
    newest = clean.groupBy(*KEY).agg(F.max(F.struct(order, *rest)).alias("_row"))
    return newest.select(*[F.col(c) if c in KEY else F.col(f"_row.{c}").alias(c) for c in COLUMNS])


def load_report(table: DataFrame) -> DataFrame:
    """Rows and distinct parcels per year."""
    return table.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pnu").alias("parcels"))

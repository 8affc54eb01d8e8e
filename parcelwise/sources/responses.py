"""Landed provider responses: JSON bodies to tables.

Bodies are taken as text; envelopes differ between responses, so the row array is located first and
then parsed with a fixed schema.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# The fields of one price row.
PRICE_FIELDS = (
    "pnu", "aphusNm", "aphusSeCodeNm", "dongNm", "floorNm", "hoNm", "prvuseAr", "pblntfPc", "stdrYear", "ldCodeNm",
)
ADDRESS_FIELDS = (
    "admCd", "mtYn", "lnbrMnnm", "lnbrSlno", "siNm", "sggNm", "emdNm", "jibunAddr", "roadAddr", "bdKdcd", "hstryYn",
)


def _schema(fields: tuple[str, ...]) -> str:
    return "array<struct<" + ",".join(f"{name}:string" for name in fields) + ">>"


def price_rows_schema() -> str:
    """Type of the column ``rows`` that :func:`decode_price_bodies` adds."""
    return _schema(PRICE_FIELDS)


def _as_array(json: Column) -> Column:
    """JSON text of a list; a single object becomes a list of one."""
    return F.when(json.startswith("["), json).when(json.startswith("{"), F.concat(F.lit("["), json, F.lit("]"))).otherwise(F.lit("[]"))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _row_list(root: Column) -> Column:
    """JSON text of the row array, wherever the envelope keeps it."""
    holder = F.coalesce(F.get_json_object(root, "$.fields"), F.get_json_object(root, "$.field"), F.lit(""))
    inner = lambda f: F.when(f.startswith("{"), F.coalesce(F.get_json_object(f, "$.field"), f)).otherwise(f)
    return _bind(holder, lambda f: _bind(inner(f), _as_array))


def decode_price_bodies(landed: DataFrame, body: str = "body") -> DataFrame:
    """Add ``error_code``, ``total`` and ``rows`` (array of price rows) to landed price responses.

    An error code short-circuits: no rows and no total.
    """
    root = F.coalesce(F.get_json_object(body, "$.apartHousingPrices"), F.get_json_object(body, "$.response"), F.col(body))

    def parts(r: Column) -> Column:
        return F.struct(
            F.nullif(F.get_json_object(r, "$.resultCode"), F.lit("")).alias("error_code"),
            F.coalesce(F.get_json_object(r, "$.totalCount").try_cast("bigint"), F.lit(0)).alias("total"),
            _row_list(r).alias("list"),
        )

    df = landed.withColumn("_d", _bind(root, parts))
    clean = F.col("_d.error_code").isNull()
    rows = F.from_json(F.when(clean, F.col("_d.list")).otherwise("[]"), _schema(PRICE_FIELDS))
    return df.select(*landed.columns, F.col("_d.error_code").alias("error_code"), F.when(clean, F.col("_d.total")).alias("total"), rows.alias("rows"))


def _price(text: Column) -> Column:
    return F.regexp_extract(F.translate(text, ",", ""), r"^\s*([+-]?[0-9]+)\s*$", 1).try_cast("bigint")


def explode_units(decoded: DataFrame, *keep: str) -> DataFrame:
    """Price rows of decoded responses in the layout of the unit table; a bad price is null.

    An outer explode: for an inner one Spark infers a filter on the array and pushes it to the scan, where every
    body would be parsed again for it.
    """
    rows = decoded.select(*keep, F.explode_outer("rows").alias("r")).where(F.col("r").isNotNull())
    return rows.select(
        *keep, F.col("r.pnu").alias("unit_pnu"), F.col("r.aphusNm").alias("name"), F.col("r.aphusSeCodeNm").alias("type"), F.col("r.dongNm").alias("dong"),
        F.col("r.floorNm").alias("floor"), F.col("r.hoNm").alias("ho"), F.col("r.prvuseAr").alias("area"), _price(F.col("r.pblntfPc")).alias("price"),
        F.col("r.stdrYear").alias("unit_year"), F.col("r.ldCodeNm").alias("ld_name"),
    )


def usable_pages(decoded: DataFrame) -> DataFrame:
    """Pages a sequential reader would have taken: from 1 without a gap, before an error or empty page.

    ``decoded`` holds (pnu, year, page) and the decoded columns.  Reading also stops once the
    announced total is reached.
    """
    pages = decoded.where(F.col("page") >= 1)
    sizes = pages.groupBy("pnu", "year", "page").agg(
        F.max(F.when(F.col("error_code").isNull(), F.size("rows")).otherwise(0)).alias("got"), F.max("total").alias("total")
    )
    in_order = Window.partitionBy("pnu", "year").orderBy("page")
    walked = (
        sizes.withColumn("_rank", F.row_number().over(in_order))
        .withColumn("_before", F.sum("got").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("got"))
        .withColumn("_total", F.first("total").over(in_order))
        .withColumn("_broken", F.max(F.col("got") == 0).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    open_end = (F.col("page") == 1) | (F.col("_before") < F.col("_total"))
    return walked.where((F.col("_rank") == F.col("page")) & ~F.col("_broken") & open_end).select("pnu", "year", "page", "got", "_total")


def reassemble(decoded: DataFrame) -> DataFrame:
    """All price rows of the usable pages."""
    return explode_units(decoded.join(usable_pages(decoded).select("pnu", "year", "page"), ["pnu", "year", "page"], "left_semi"), "pnu", "year")


def completeness(decoded: DataFrame) -> DataFrame:
    """Received against announced rows of every (pnu, year); ``expected`` feeds the not-found report."""
    return usable_pages(decoded).groupBy("pnu", "year").agg(
        F.sum("got").alias("received"), F.greatest(F.max("_total"), F.sum("got")).alias("expected"), F.max("page").alias("pages")
    ).withColumn("complete", F.col("received") >= F.col("expected"))


@dataclass(frozen=True)
class PriceTables:
    """What landed price answers say: units, announced totals, errors that left a parcel without units."""

    units: DataFrame  # the unit table
    expected: DataFrame  # pnu, year, received, expected, pages, complete
    errors: DataFrame  # pnu, year, error_code


def price_tables(landed: DataFrame) -> PriceTables:
    """Landed pages (pnu, year, page, body) as the tables a lookup reads.

    An error on the first page leaves the parcel without units in that year; on a later page it ends the reading there,
    and the announced total tells that units are missing.  A first page that landed more than once with different
    errors gives the smallest code, and none where one of them was read.
    """
    decoded = stored(decode_price_bodies(landed.select("pnu", "year", "page", "body")).drop("body"), "price-answers")
    first = decoded.where(F.col("page") == 1).groupBy("pnu", "year").agg(
        F.min("error_code").alias("error_code"), F.max(F.col("error_code").isNull()).alias("_read")
    )
    return PriceTables(reassemble(decoded), completeness(decoded), first.where(~F.col("_read")).drop("_read"))


def decode_primary(landed: DataFrame) -> DataFrame:
    """First provider's bodies (query, body) to candidate rows; errors and empty answers keep one row."""
    df = landed.withColumn("_code", F.get_json_object("body", "$.results.common.errorCode"))
    df = df.withColumn(
        "error",
        F.when(F.col("_code").isNotNull() & (F.col("_code") != "0"), F.coalesce(F.get_json_object("body", "$.results.common.errorMessage"), F.lit(""))),
    )
    items = F.from_json(_as_array(F.get_json_object("body", "$.results.juso")), _schema(ADDRESS_FIELDS))
    rows = df.select("query", "error", F.posexplode_outer(F.when(F.col("error").isNull(), items)).alias("pos", "i"))
    return rows.select(
        "query", "pos", F.col("i.admCd").alias("adm_code"), F.coalesce("i.mtYn", F.lit("0")).alias("mountain"), F.col("i.lnbrMnnm").alias("main_lot"),
        F.col("i.lnbrSlno").alias("sub_lot"), F.col("i.siNm").alias("sido"), F.col("i.sggNm").alias("sigungu"), F.col("i.emdNm").alias("emd"),
        F.col("i.jibunAddr").alias("lot_address"), F.col("i.roadAddr").alias("road_address"), F.col("i.bdKdcd").alias("building_kind"),
        F.col("i.hstryYn").alias("history"), "error",
    )


def decode_secondary(landed: DataFrame) -> DataFrame:
    """Second provider's bodies (query, body) to document rows; empty answers give no row."""
    schema = "array<struct<address:struct<b_code:string,mountain_yn:string,main_address_no:string,sub_address_no:string,address_name:string>>>"
    docs = F.from_json(_as_array(F.get_json_object("body", "$.documents")), schema)
    rows = landed.select("query", F.posexplode(docs).alias("pos", "d"))
    a = F.col("d.address")
    return rows.select(
        "query", "pos", a["b_code"].alias("adm_code"), F.coalesce(a["mountain_yn"], F.lit("N")).alias("mountain"), a["main_address_no"].alias("main_lot"),
        a["sub_address_no"].alias("sub_lot"), a["address_name"].alias("address_name"),
        F.coalesce(a["b_code"], a["main_address_no"], a["address_name"]).isNotNull().alias("has_address"),
    )

"""Parcel keys, unit tokens and register numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def mountain_flag(value: Column, source: str = "pnu") -> Column:
    """Land flag of a parcel key: '2' for mountain lots, '1' otherwise (also when unknown)."""
    text = _blank(value)
    if source == "juso":
        is_mountain = text == "1"
    elif source == "kakao":
        is_mountain = F.upper(text) == "Y"
    else:
        is_mountain = (text == "2") | text.contains("산")
    return F.when(is_mountain, F.lit("2")).otherwise(F.lit("1"))


def pad4(value: Column) -> Column:
    """Lot number as four digits; blank means '0000'; anything not 1-4 digits is null."""
    text = _blank(value)
    return F.when(text == "", F.lit("0000")).when(text.rlike("^[0-9]{1,4}$"), F.lpad(text, 4, "0"))


def build_pnu(code: Column, main_lot: Column, sub_lot: Column, mountain: Column, source: str = "juso") -> Column:
    """19-digit parcel key, or null when any part is malformed (see :func:`pnu_problem`)."""
    text = _blank(code)
    return F.when(
        text.rlike("^[0-9]{10}$"),
        F.concat(text, mountain_flag(mountain, source), pad4(main_lot), pad4(sub_lot)),
    )


def pnu_problem(code: Column, main_lot: Column, sub_lot: Column) -> Column:
    """Reason code of the first malformed part, or null for a good key."""

    def lot(value: Column, name: str) -> Column:
        text = _blank(value)
        return (
            F.when((text != "") & ~text.rlike("^[0-9]+$"), F.lit(f"{name}_not_numeric"))
            .when(F.length(text) > 4, F.lit(f"{name}_too_long"))
        )

    return F.coalesce(
        F.when(~_blank(code).rlike("^[0-9]{10}$"), F.lit("code_not_10_digits")),
        lot(main_lot, "main_lot"),
        lot(sub_lot, "sub_lot"),
    )


def split_pnu(pnu: Column) -> Column:
    """Struct (code, flag, main_lot, sub_lot) of a well-formed key, else null."""
    text = _blank(pnu)
    parts = F.struct(
        F.substring(text, 1, 10).alias("code"),
        F.substring(text, 11, 1).alias("flag"),
        F.substring(text, 12, 4).alias("main_lot"),
        F.substring(text, 16, 4).alias("sub_lot"),
    )
    return F.when(text.rlike("^[0-9]{19}$"), parts)


def unit_token(value: Column) -> Column:
    """Comparable form of a building, floor or unit label.

    Blanks, the leading ordinal mark and trailing unit words go away and every digit run loses its
    leading zeros.  Letter prefixes stay, so a basement unit never equals the plain number.
    """
    text = F.translate(_blank(value), " ", "")
    text = F.rtrim(F.ltrim(text, F.lit("제")), F.lit("호동층"))
    return F.lower(F.regexp_replace(text, "(^|[^0-9])0+([0-9])", "$1$2"))


def unit_key(dong: Column, floor: Column, ho: Column) -> Column:
    """Identity of one unit across years within a parcel."""
    return F.concat_ws("|", unit_token(dong), unit_token(floor), unit_token(ho))


_REGISTER_NO = r"^\s*([0-9]{4})-?([0-9]{4})-?([0-9]{6})\s*$"


def is_register_number(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike(_REGISTER_NO)


def register_number(value: Column) -> Column:
    """14 digits without hyphens, or null when the text is no register number."""
    return F.when(is_register_number(value), F.regexp_replace(value, _REGISTER_NO, "$1$2$3"))


def first_number(value: Column) -> Column:
    """First digit run as a number (null without digits), the natural order of unit labels."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), "([0-9]+)", 1).try_cast("decimal(38,0)")


def natural_order(*columns: Column) -> list[Column]:
    """Sort expressions: labels with a number first by that number, then plain texts."""
    order: list[Column] = []
    for column in columns:
        number = first_number(column)
        order += [
            F.when(number.isNull(), F.lit(1)).otherwise(F.lit(0)),
            number.asc(),
            F.when(number.isNull(), column).asc(),
        ]
    return order

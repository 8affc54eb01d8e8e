"""Tolerant number parsing and small numeric projections.

Spark 4 runs in ANSI mode: a plain ``cast`` of bad text fails the job, and ``try_cast`` still
accepts Java suffixes such as ``12f``.  Every parser therefore guards the text with a pattern first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGNED_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PLAIN_NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _number(text: Column, pattern: str) -> Column:
    """Double of a text that matches the pattern as a whole, null otherwise (one evaluation)."""
    return F.regexp_extract(text, pattern, 0).try_cast("double")


def parse_price_signed(value: Column) -> Column:
    """Listing variant: commas and quotes dropped, sign and exponent allowed, truncated."""
    text = F.trim(F.translate(value.cast("string"), ',"', ""))
    return _number(text, _SIGNED_NUMBER).try_cast("bigint")


def parse_price_plain(value: Column) -> Column:
    """Statistics variant: commas and blanks dropped, digits and one dot only, truncated."""
    text = F.translate(value.cast("string"), ", \t", "")
    return _number(text, _PLAIN_NUMBER).try_cast("bigint")


def parse_area(value: Column) -> Column:
    """Decimal number with optional thousands separators; anything else is null."""
    text = F.trim(F.translate(value.cast("string"), ',"', ""))
    return _number(text, _SIGNED_NUMBER)


def price_per_m2(price: Column, area: Column) -> Column:
    """Won per square metre, rounded half to even; null without a positive area."""
    return F.when(area > 0, F.bround(price / area)).cast("bigint")


def district_code(code: Column, strict: bool = True) -> Column:
    """First five characters of a legal-dong code.

    strict: they must be digits.  loose: any text of at least five characters, quotes removed.
    """
    if strict:
        text = F.trim(_text(code))
        return F.when(text.rlike("^[0-9]{5}"), F.substring(text, 1, 5))
    text = F.trim(F.trim(_text(code)), F.lit('"'))
    return F.when(F.length(text) >= 5, F.substring(text, 1, 5))


def normal_type(value: Column) -> Column:
    """Housing type label: apartment, row house, multi-household, else the raw text."""
    text = F.trim(_text(value))
    return (
        F.when(text.contains("아파트"), F.lit("아파트"))
        .when(text.contains("연립"), F.lit("연립"))
        .when(text.contains("다세대"), F.lit("다세대"))
        .when(text == "", F.lit("기타"))
        .otherwise(text)
    )


def is_target_type(value: Column) -> Column:
    """Types the guarantee rule applies to."""
    return F.coalesce(value, F.lit("")).rlike("연립|다세대")

"""Korean money texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def parse_money(value: Column) -> Column:
    """Won amount of texts such as '1억 8천' or '18,000만원'; null when nothing is recognised.

    A bare 천 means ten million.  When a 만 part is present a separate 천 part is not counted.
    """
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s,]", "")

    def part(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found.try_cast("double"))

    hundred_million = part(_NUMBER + "억")
    ten_thousand = part(_NUMBER + "(?:천만|만)")
    thousand = part(_NUMBER + "천(?!만)")
    unit = F.when(text.contains("천만"), F.lit(10_000_000.0)).otherwise(F.lit(10_000.0))
    small = F.when(ten_thousand.isNotNull(), ten_thousand * unit).otherwise(thousand * F.lit(10_000_000.0))
    total = F.coalesce(hundred_million * F.lit(100_000_000.0), F.lit(0.0)) + F.coalesce(small, F.lit(0.0))
    matched = hundred_million.isNotNull() | small.isNotNull()
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).when(matched, F.floor(total + F.lit(0.5)).cast("bigint"))


def _grouped(value: Column) -> Column:
    return F.format_number(value, 0)


def format_money(value: Column) -> Column:
    """'1억 8,000만원' style; both parts are cut, amounts under 10,000 are shown in won."""
    big = F.floor(value / F.lit(100_000_000)).cast("bigint")
    small = F.floor(F.pmod(value, F.lit(100_000_000)) / F.lit(10_000)).cast("bigint")
    joined = F.concat_ws(
        " ",
        F.when(big != 0, F.concat(big.cast("string"), F.lit("억"))),
        F.when(small != 0, F.concat(_grouped(small), F.lit("만"))),
    )
    return (
        F.when(value.isNull(), F.lit("-"))
        .when(value == 0, F.lit("0원"))
        .when(joined != "", F.concat(joined, F.lit("원")))
        .otherwise(F.concat(_grouped(value), F.lit("원")))
    )


def format_money_rounded(value: Column) -> Column:
    """Variant whose 만 part is rounded half up."""
    big = F.floor(value / F.lit(100_000_000)).cast("bigint")
    small = F.floor(F.pmod(value, F.lit(100_000_000)) / F.lit(10_000) + F.lit(0.5)).cast("bigint")
    joined = F.concat_ws(
        " ",
        F.when(big > 0, F.concat(big.cast("string"), F.lit("억"))),
        F.when(small > 0, F.concat(_grouped(small), F.lit("만"))),
    )
    return F.concat(F.when(joined != "", joined).otherwise(F.lit("0")), F.lit("원"))


def format_won(value: Column) -> Column:
    return F.concat(_grouped(value), F.lit("원"))

"""Deposit-guarantee rule: limits, required price, histogram share, grade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the price histogram: 50 bins of 10 million won plus one overflow bin.
BIN_SIZE = 10_000_000
BIN_MAX = 500_000_000
BIN_COUNT = BIN_MAX // BIN_SIZE

# Fixed values of the grade ladder.
GOOD_FROM = 0.7
MID_FROM = 0.3


@dataclass(frozen=True)
class Policy:
    """Parameters of the rule; the product of the two rates is the 126 % factor."""

    version: str = "2023-05"
    price_rate: float = 1.4
    loan_to_value: float = 0.9
    targets: tuple[str, ...] = ("연립", "다세대")


POLICY = Policy()


def _rate(value: float) -> Column:
    return F.lit(float(value))


def limit_from_price(price: Column, policy: Policy = POLICY) -> Column:
    """Highest sum of senior claims and deposit an official price supports."""
    amount = F.floor(price.cast("double") * _rate(policy.price_rate) * _rate(policy.loan_to_value))
    return F.when(price > 0, amount).otherwise(F.lit(0)).cast("bigint")


def max_deposit(price: Column, senior: Column, policy: Policy = POLICY) -> Column:
    return F.greatest(F.lit(0), limit_from_price(price, policy) - F.coalesce(senior, F.lit(0))).cast("bigint")


def required_price(deposit: Column, senior: Column, policy: Policy = POLICY) -> Column:
    """Lowest official price that covers deposit plus senior claims; 0 without a deposit."""
    total = (deposit + F.coalesce(senior, F.lit(0))).cast("double")
    return F.when(deposit > 0, F.ceil(total / _rate(policy.price_rate * policy.loan_to_value))).otherwise(F.lit(0)).cast("bigint")


def histogram_bin(price: Column) -> Column:
    return F.least(F.floor(price / F.lit(BIN_SIZE)), F.lit(BIN_COUNT)).cast("int")


def ratio_at_least(hist: Column, threshold: Column, bin_size: int = BIN_SIZE) -> Column:
    """Share of a histogram at or above a threshold.

    A bin the threshold falls into counts by linear interpolation; the last bin is taken to be one
    bin wide.  Null for an empty histogram, otherwise within 0..1.
    """
    size = F.lit(float(bin_size))
    last = F.size(hist) - 1
    limit = threshold.cast("double")

    def share(count: Column, index: Column) -> Column:
        low = index.cast("double") * size
        high = low + size
        straddles = (index == last) | (high > limit)
        return (
            F.when(low >= limit, count.cast("double"))
            .when(straddles, count.cast("double") * (high - limit) / size)
            .otherwise(F.lit(0.0))
        )

    total = F.aggregate(hist, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    above = F.aggregate(F.transform(hist, share), F.lit(0.0), lambda acc, n: acc + n)
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), above / total.cast("double"))))


def grade(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), F.lit(None).cast("string"))
        .when(ratio >= GOOD_FROM, F.lit("GOOD"))
        .when(ratio >= MID_FROM, F.lit("MID"))
        .otherwise(F.lit("HARD"))
    )


def grade_rank(name: Column) -> Column:
    """Display order of grades."""
    return F.when(name == "GOOD", 0).when(name == "MID", 1).otherwise(2)

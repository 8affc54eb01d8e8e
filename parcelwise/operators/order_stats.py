"""Exact order statistics that never gather a whole group in one task.

A group may hold a third of all rows, so neither ``percentile`` (one buffer per group) nor a plain
ranking window (one task per group) is safe.  Instead:

1. rows are counted per (group, value): equal values collapse before the shuffle and the key spreads
   a hot group over all tasks;
2. every value belongs to a *slice* ``floor(value / width)``; slice totals per group are few and give
   each slice its first rank;
3. only the slices that contain a wanted rank are ranked in full, keyed by (group, slice).

The slice function is monotone, so results are exact whatever the width; the width only sets how
many distinct values one task ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_SLICE = 1_000_000.0


def count_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, cnt): the pre-aggregated form all statistics start from."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def pick_ranks(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Column],
    slice_width: float = PRICE_SLICE,
    count: str = "cnt",
) -> DataFrame:
    """Values at given zero-based ranks of every group.

    ``counted`` holds one row per (keys, value) with its count; keys and value are not null.
    ``ranks`` maps an output name to an expression over ``n``, the number of rows of the group.
    Returns keys, n and one column per rank.
    """
    keys = list(keys)
    sliced = counted.select(
        *keys,
        F.col(value).alias("_v"),
        F.col(count).alias("_c"),
        F.floor(F.col(value) / F.lit(float(slice_width))).cast("bigint").alias("_slice"),
    )
    by_group = Window.partitionBy(*keys)
    totals = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_c").alias("_size"))
        .withColumn("_upto", F.sum("_size").over(by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_size").over(by_group))
        .withColumn("_from", F.col("_upto") - F.col("_size"))
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    targets = (
        totals.withColumn("_wanted", F.filter(wanted, lambda r: (r["rank"] >= F.col("_from")) & (r["rank"] < F.col("_upto"))))
        .where(F.size("_wanted") > 0)
        .select(*keys, "_slice", "n", "_from", "_wanted")
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(targets, [*keys, "_slice"]).withColumn("_last", F.col("_from") + F.sum("_c").over(in_slice))
    found = ranked.select(
        *keys,
        "n",
        "_v",
        F.explode(
            F.filter("_wanted", lambda r: (r["rank"] >= F.col("_last") - F.col("_c")) & (r["rank"] < F.col("_last")))
        ).alias("_hit"),
    )
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_hit.name") == name, F.col("_v"))).alias(name) for name in ranks],
    )


def interpolated_quantiles(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    slice_width: float,
    count: str = "cnt",
) -> DataFrame:
    """Linearly interpolated quantiles (position ``q * (n - 1)``) of every group as doubles."""
    n = F.col("n")

    def position(q: float) -> Column:
        return F.lit(float(q)) * (n - 1).cast("double")

    ranks: dict[str, Column] = {}
    for name, q in quantiles.items():
        ranks[f"_lo_{name}"] = F.floor(position(q))
        ranks[f"_hi_{name}"] = F.ceil(position(q))
    picked = pick_ranks(counted, keys, value, ranks, slice_width, count)
    outputs = []
    for name, q in quantiles.items():
        low = F.col(f"_lo_{name}").cast("double")
        high = F.col(f"_hi_{name}").cast("double")
        outputs.append((low + (high - low) * (position(q) - F.floor(position(q)))).alias(name))
    return picked.select(*keys, "n", *outputs)

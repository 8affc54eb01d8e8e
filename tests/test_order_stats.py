import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import areas as A
from parcelwise.operators.order_stats import count_values, interpolated_quantiles, pick_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and many equal values; small groups hold one to five rows."""
    rng = random.Random(7)
    rows = [("hot", rng.choice([10, 20, 5_000_000, rng.randrange(600_000_000)])) for _ in range(3000)]
    rows += [(f"g{i}", rng.randrange(1, 400_000_000)) for i in range(40) for _ in range(1 + i % 5)]
    return rows, spark.createDataFrame(rows, "g string, v bigint")


def groups_of(rows):
    grouped = {}
    for g, v in rows:
        grouped.setdefault(g, []).append(v)
    return {g: sorted(vs) for g, vs in grouped.items()}


@pytest.mark.parametrize("width", [1.0, 1_000_000.0, 1e12])
def test_ranks_do_not_depend_on_the_slice_width(skewed, width):
    rows, df = skewed
    n = F.col("n")
    ranks = {"low": F.lit(0), "p25": F.floor(n / 4), "p75": F.floor(3 * n / 4), "high": n - 1}
    found = {r["g"]: r for r in pick_ranks(count_values(df, ["g"], "v"), ["g"], "v", ranks, width).collect()}
    for g, vs in groups_of(rows).items():
        size = len(vs)
        assert [found[g][k] for k in ("n", "low", "p25", "p75", "high")] == [size, vs[0], vs[size // 4], vs[3 * size // 4], vs[-1]]


def test_quantiles_interpolate(skewed):
    rows, df = skewed
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    found = {r["g"]: r for r in interpolated_quantiles(count_values(df, ["g"], "v"), ["g"], "v", qs, 1e6).collect()}
    for g, vs in groups_of(rows).items():
        for name, q in qs.items():
            assert found[g][name] == pytest.approx(np.quantile(vs, q))


def test_area_statistics(spark):
    prices = [10_000_000, 499_999_999, 500_000_000, 900_000_000, 0, 120_000_000, 130_000_000]
    rows = [("11530", "가동", "다세대", p) for p in prices] + [("11530", "나동", "연립", 5)] * 4 + [("11110", "다동", "연립", 5)] * 2
    counted = A.value_counts(A.target_units(spark.createDataFrame(rows, "code string, dong string, type string, price bigint")))
    stats = A.dong_stats(counted).collect()
    assert [r["dong"] for r in stats] == ["가동"]
    kept = sorted(p for p in prices if p > 0)
    row = stats[0]
    assert (row["count"], row["avg"], row["median"]) == (6, sum(kept) // 6, (kept[2] + kept[3]) // 2)
    assert (row["p25"], row["p75"], row["min"], row["max"]) == (kept[1], kept[4], kept[0], kept[-1])
    assert len(row["hist"]) == 51 and sum(row["hist"]) == 6 and row["hist"][50] == 2 and row["hist"][49] == 1
    districts = A.district_stats(counted).collect()
    assert [(d["code"], d["count"], d["area_count"], d["total_count"]) for d in districts] == [("11530", 10, 1, 6)]

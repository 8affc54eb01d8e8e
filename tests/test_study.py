import random
import statistics

import pytest

from parcelwise.operators import study as S
from parcelwise.session import stored


def rows():
    rng = random.Random(4)
    found = []
    for _ in range(400):
        area, price = rng.choice((20.0, 40.0, 50.0, 70.0, 100.0)), float(rng.randint(1, 60)) * 1_000_000
        found.append((rng.choice("ab"), area, price, price / area, rng.choice(("서울", "지방")), next(x for edge, x in zip((30, 45, 60, 85, 999), S.AREA_LABELS) if area < edge)))
    return found


@pytest.fixture(scope="module")
def kept(spark):
    return stored(spark.createDataFrame(rows(), "group string, area double, price double, unit_price double, region string, area_bin string"), "study-source")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_area_bins_read_the_rows_once(kept):
    table = S.area_bin_table(kept)
    assert "study-source" not in plan(table)
    for r in table.collect():
        mine = [x for x in rows() if x[5] == r["area_bin"] and r["scope"] in (S.ALL, x[4])]
        assert r["n"] == len(mine)
        assert r["median_unit"] == pytest.approx(statistics.median(x[3] for x in mine))
        assert r["mean_price"] == pytest.approx(statistics.fmean(x[2] for x in mine))


def test_training_stats_read_counts(kept):
    by_group, by_bin = S.training_stats(kept)
    assert "study-source" not in plan(by_group) + plan(by_bin)
    for table, keys, prefix in ((by_group, (0,), "g_"), (by_bin, (0, 5), "b_")):
        found = table.collect()
        names = ("group", "area_bin")[: len(keys)]
        assert len(found) == len({tuple(x[k] for k in keys) for x in rows()})
        for r in found:
            mine = [x for x in rows() if all(x[k] == r[n] for k, n in zip(keys, names))]
            assert r[f"{prefix}unit"] == pytest.approx(statistics.median(x[3] for x in mine))
            low, mid, high = statistics.quantiles([x[2] for x in mine], n=4, method="inclusive")
            assert (r[f"{prefix}p25"], r[f"{prefix}p50"], r[f"{prefix}p75"]) == pytest.approx((low, mid, high))

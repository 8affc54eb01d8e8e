import re

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import keyed
from parcelwise.operators import officetel as O
from parcelwise.operators import units as U

UNIT = "pnu string, year string, dong string, floor string, ho string, price bigint, name string, type string"
REQUEST = "request_id bigint, pnu string, dong string, ho string"


def run(spark, units, dong, ho, year="2026"):
    rows = spark.createDataFrame([("P", y, d, f, h, p, "단지", "다세대") for y, d, f, h, p in units], UNIT)
    requests = spark.createDataFrame([(1, "P", dong, ho)], REQUEST)
    matched = U.match_units(requests, rows, year)
    explained = U.explain_missing(matched, rows, year)
    return U.attach_last_year(explained, rows, "2025").collect()[0]


THREE = [("2026", "", "2", "201", 158_000_000), ("2026", "", "2", "202", 226_000_000), ("2026", "", "2", "203", 226_000_000)]
BLOCKS = [("2026", d, "14", h, 500_000_000 + (d == "105" and h == "1403")) for d in ("104", "105") for h in ("1402", "1403")]


@pytest.mark.parametrize("units, dong, ho, price, needs, tier", [
    (THREE, None, "202", 226_000_000, False, 1),
    (THREE, None, None, None, True, None),
    (THREE, "105", "203", 226_000_000, False, 3),
    (BLOCKS, "105", "1403", 500_000_001, False, 1),
    (BLOCKS, None, "1403", None, True, 2),
    (BLOCKS, "105", None, None, True, 2),
    (BLOCKS, "999", "1403", None, True, None),
    ([("2026", "제106동", "8", "0802", 9), ("2026", "제218동", "8", "0802", 8)], "106", "802", 9, False, 2),
    ([("2026", "106", "8", "802", 9), ("2026", "제106동", "8", "0802", 8)], "106", "802", 9, False, 1),
    ([("2026", "", "1", "101", 7)], None, "999", 7, False, None),
    ([("2026", "B", "1", "B101", 7), ("2026", "A", "1", "101", 8)], None, "101", 8, False, 1),
    ([("2025", "", "1", "101", 7)], None, "101", None, False, None),
])
def test_match(spark, units, dong, ho, price, needs, tier):
    row = run(spark, units, dong, ho)
    assert (row["price"], row["needs_unit"], row["tier"]) == (price, needs, tier)


def test_last_year_needs_exactly_one_unit(spark):
    units = [("2026", "제103동", "8", "0802호", 228), ("2025", "103", "8", "802", 240)]
    assert run(spark, units, "103", "802")["price_last"] == 240
    doubled = run(spark, [*units, ("2025", "103동", "8", "802호", 241)], "103", "802")
    assert doubled["price_last"] is None and any("동일키 2건" in w for w in doubled["warnings_last"])


def test_messages(spark):
    assert any("입력한 999동" in w and "조회된 동 2개: 104, 105" in w for w in run(spark, BLOCKS, "999", "1403")["warnings"])
    assert any("105동에 77호가 없어요 (105동 2세대: 1402, 1403…)" in w for w in run(spark, BLOCKS, "105", "77")["warnings"])
    assert "입력 호(999)와 자료상 호(101)가 달라요 - 확인 필요" in run(spark, [("2026", "", "1", "101", 7)], None, "999")["warnings"]


def test_every_request_comes_back_once(spark):
    units = spark.createDataFrame([("P", "2026", "", "1", str(i % 9), i, "x", "연립") for i in range(300)], UNIT)
    requests = spark.range(200).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "Q").otherwise("P").alias("pnu"),
        F.lit(None).cast("string").alias("dong"), (F.col("id") % 11).cast("string").alias("ho"),
    )
    found = U.match_units(requests, units, "2026")
    assert found.count() == 200 and found.select("request_id").distinct().count() == 200


def test_officetel(spark):
    rows = [("P", "4771025300", "타워", "1", "2", "201", 26.5, 10.25, 1_480_000, "2025"), ("P", "4771025300", "타워", "1", "2", "201", 26.5, 10.25, 1_520_000, "2026"),
            ("P", "4771025300", "타워", "1", "2", "202", 30.0, None, 1_000, "2026")]
    table = spark.createDataFrame(rows, "pnu string, ldcode string, building string, dong string, floor string, ho string, prvuse double, share double, price bigint, year string")
    requests = spark.createDataFrame([(1, "P", None, "201호"), (2, "P", None, "999"), (3, "P", None, None)], REQUEST)
    found = {r["request_id"]: r for r in O.attach_last_year(O.match_officetel(requests, table, "2026"), table, "2025").collect()}
    assert (found[1]["price"], found[1]["price_last"]) == (55_860_000, 54_390_000)  # 36.75 square metres
    assert (found[2]["price"], found[2]["needs_unit"]) == (None, False) and "미매칭" in found[2]["warnings"][0]
    assert (found[3]["price"], found[3]["needs_unit"]) == (None, True)


def test_upsert_keeps_the_last_load(spark):
    row = ("P", "1", None, "1", "1", "1", 1.0, None)
    loads = spark.createDataFrame([(*row, 5, "2026", 1), (*row, 6, "2026", 2), (*row, 4, "2025", 1)], "pnu string, ldcode string, building string, dong string, floor string, ho string, prvuse double, share double, price bigint, year string, load_seq int")
    assert sorted((r["year"], r["price"], r["building"]) for r in O.latest_per_key(loads).collect()) == [("2025", 4, ""), ("2026", 6, "")]


def test_hot_parcel_is_spread(spark, monkeypatch):
    """A parcel is split by its size, others are not copied; behind that, rows are exchanged on the full key."""
    monkeypatch.setattr(keyed, "ROWS_PER_TASK", 150)
    units = [("HOT" if n % 3 else f"P{n}", "2026", "", "1", str(n % 900), n, "단지", "다세대") for n in range(1, 3000)]
    facts = spark.createDataFrame(units, UNIT)
    hot = [u for u in units if u[0] == "HOT"]
    assert [tuple(r) for r in keyed.split_parcels(facts).collect()] == [("HOT", -(-len(hot) // 150))]
    asked = [(1, "HOT", None, "7"), (2, "P3", None, "3"), (3, "HOT", None, "none"), (4, "HOT", None, None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spread = keyed.of_parcels(facts, spark.createDataFrame([("HOT",), ("P3",)], "pnu string"))
        plan = spread._jdf.queryExecution().executedPlan().toString()
        parts = spread.groupBy(F.spark_partition_id().alias("part")).agg(F.sum((F.col("pnu") == "HOT").cast("int")).alias("n")).collect()
        got = {r["request_id"]: (r["total"], r["candidates"], r["price"]) for r in U.match_units(spark.createDataFrame(asked, REQUEST), facts, "2026").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert spread.count() == len(hot) + 1
    assert len(parts) == 4 and max(r["n"] for r in parts) < 0.6 * len(hot)
    sevens = sum(u[4] == "7" for u in hot)
    assert got == {1: (len(hot), sevens, None), 2: (1, 1, 3), 3: (len(hot), 0, None), 4: (len(hot), 0, None)}
    assert any("_salt" in e for e in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan))
    table = keyed.count_by_keys(spread, [keyed.Key("ho", F.col("ho"), F.lit(""))], F.col("price"))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pnu" in plan and "SortAggregate" not in plan and plan.count("HashAggregate(") >= 2


def test_steps_of_a_two_year_match_are_stored(spark):
    rows = spark.createDataFrame([("P", y, d, f, h, p, "단지", "다세대") for y, d, f, h, p in BLOCKS], UNIT)
    requests = spark.createDataFrame([(1, "P", "105", "1403")], REQUEST)
    both = U.attach_last_year(U.match_units(requests, rows, "2026"), rows, "2025")
    text = both._jdf.queryExecution().executedPlan().toString()
    assert "matched-units" in text and "last-counts" in text and "asked-units" not in text

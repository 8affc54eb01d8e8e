import pytest
from pyspark.sql import functions as F

from parcelwise.functions import guarantee as G
from parcelwise.functions import mapcode, money
from parcelwise.functions import numbers as N

c = F.col
HIST = [2] * 10 + [5] * 10 + [3] * 10 + [0] * 21


@pytest.mark.parametrize("price, limit", [(150_000_000, 189_000_000), (200_000_000, 252_000_000), (0, 0), (-5, 0)])
def test_limit(value, price, limit):
    assert value(G.limit_from_price(c("p")), p=price) == limit


def test_deposit_and_required_price(value):
    assert value(G.max_deposit(c("p"), c("s")), p=150_000_000, s=50_000_000) == 139_000_000
    assert value(G.max_deposit(c("p"), c("s")), p=100_000_000, s=200_000_000) == 0
    assert value(G.required_price(c("d"), c("s")), d=200_000_000, s=0) == 158_730_159
    assert value(G.required_price(c("d"), c("s")), d=0, s=0) == 0
    back = value(G.required_price(G.max_deposit(c("p"), c("s")), c("s")), p=180_000_000, s=30_000_000)
    assert back <= 180_000_001


@pytest.mark.parametrize("threshold, ratio", [(0, 1.0), (100_000_000, 0.8), (150_000_000, 0.55), (200_000_000, 0.3), (500_000_000, 0.0)])
def test_ratio(spark, threshold, ratio):
    row = spark.createDataFrame([(HIST,)], "h array<bigint>").select(G.ratio_at_least(c("h"), F.lit(threshold)).alias("r")).collect()[0]
    assert row["r"] == pytest.approx(ratio)


def test_ratio_of_nothing(spark):
    rows = spark.createDataFrame([([],), ([0, 0],)], "h array<bigint>")
    assert [r[0] for r in rows.select(G.ratio_at_least(c("h"), F.lit(1))).collect()] == [None, None]


@pytest.mark.parametrize("ratio, grade", [(0.9, "GOOD"), (0.7, "GOOD"), (0.5, "MID"), (0.3, "MID"), (0.1, "HARD")])
def test_grade(value, ratio, grade):
    assert value(G.grade(c("r")), r=ratio) == grade


@pytest.mark.parametrize("text, won", [
    ("180000000", 180_000_000), ("1억 8천", 180_000_000), ("2억", 200_000_000), ("1억8000만원", 180_000_000), ("18,000만원", 180_000_000),
    ("5천", 50_000_000), ("8천500만", 5_000_000), ("", None), ("abc", None), (None, None),
])
def test_parse_money(value, text, won):
    assert value(money.parse_money(c("t")), t=text) == won


def test_format_money(value):
    assert value(money.format_money(c("n")), n=180_000_000) == "1억 8,000만원"
    assert value(money.format_money(c("n")), n=0) == "0원"
    assert value(money.format_money(c("n")), n=9_999) == "9,999원"
    assert value(money.format_money_rounded(c("n")), n=123_456_789) == "1억 2,346만원"


def test_map_code(value):
    assert value(mapcode.map_center(c("a"), c("o")), a=35.152, o=126.848) == "3zccXm-2z8JLW"
    back = value(mapcode.read_map_center(c("t")), t="3zccXm-2z8JLW")
    assert (back["lat"], back["lon"]) == (pytest.approx(35.152), pytest.approx(126.848))
    assert value(mapcode.read_map_center(c("t")), t="nothing") is None


@pytest.mark.parametrize("text, signed, plain", [
    ("1,234", 1234, 1234), ("-1,500", -1500, None), ("5e7", 50_000_000, None), ('"70,000"', 70_000, None), ("12.9", 12, 12), ("12f", None, None),
    ("N/A", None, None), ("", None, None), ("1 000", None, 1000), (".", None, None), ("1e400", None, None),
])
def test_number_parsing(value, text, signed, plain):
    assert value(N.parse_price_signed(c("t")), t=text) == signed
    assert value(N.parse_price_plain(c("t")), t=text) == plain

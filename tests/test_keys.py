import pytest
from pyspark.sql import functions as F

from parcelwise.functions import keys as K

c = F.col


@pytest.mark.parametrize("code, main, sub, mountain, expected", [
    ("4771025300", "86", "15", "0", "4771025300100860015"),
    ("4771025300", "2041", None, "0", "4771025300120410000"),
    ("4771025300", "7", "120", "1", "4771025300200070120"),
    ("47710", "1", None, "0", None),
    ("4771025300", "10000", None, "0", None),
    ("4771025300", "7b", None, "0", None),
])
def test_parcel_key(value, code, main, sub, mountain, expected):
    args = dict(code=code, main=main, sub=sub, mountain=mountain)
    assert value(K.build_pnu(c("code"), c("main"), c("sub"), c("mountain")), **args) == expected
    assert (value(K.pnu_problem(c("code"), c("main"), c("sub")), **args) is None) == (expected is not None)


def test_split(value):
    parts = value(K.split_pnu(c("p")), p="4771025300100860015")
    assert (parts["code"], parts["flag"], parts["main_lot"], parts["sub_lot"]) == ("4771025300", "1", "0086", "0015")


@pytest.mark.parametrize("text, source, flag", [("Y", "kakao", "2"), ("N", "kakao", "1"), ("1", "juso", "2"), (None, "juso", "1"), ("산", "pnu", "2"), ("대지", "pnu", "1")])
def test_mountain(value, text, source, flag):
    assert value(K.mountain_flag(c("t"), source), t=text) == flag


@pytest.mark.parametrize("text, token", [
    ("12", "12"), ("제12동", "12"), ("0012", "12"), ("907호", "907"), ("B0203", "b203"), ("b203", "b203"), ("B203", "b203"),
    ("지하3", "지하3"), ("나동", "나"), ("000", "0"), (None, ""), ("12-0907", "12-907"),
])
def test_unit_token(value, text, token):
    assert value(K.unit_token(c("t")), t=text) == token


def test_register_number(value):
    assert value(K.register_number(c("t")), t="4771-2007-310258") == "47712007310258"
    assert value(K.register_number(c("t")), t=" 47712007310258 ") == "47712007310258"
    assert value(K.register_number(c("t")), t="누리동 86-15") is None


def test_natural_order(spark):
    rows = spark.createDataFrame([("20", "3"), ("다", "2"), ("9", "110"), ("9", "21"), ("20", "110")], "dong string, ho string")
    ordered = [tuple(r) for r in rows.orderBy(*K.natural_order(c("dong"), c("ho"))).collect()]
    assert ordered == [("9", "21"), ("9", "110"), ("20", "3"), ("20", "110"), ("다", "2")]

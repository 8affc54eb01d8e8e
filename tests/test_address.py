import pytest
from pyspark.sql import functions as F

from parcelwise.functions import address as A


def parse(spark, text):
    row = A.parse_address(spark.createDataFrame([(text,)], "q string"), "q")
    p = F.col("parsed")
    return row.select("parsed.*", A.input_class(F.col("q"), p).alias("kind"), A.lot_address(p).alias("lot"), A.search_query(p).alias("query")).collect()[0]


@pytest.mark.parametrize("text, expected", [
    ("대전광역시 물결구 누리동 86-15 새봄빌라 제4층 제409호", dict(sido="대전광역시", sigungu="물결구", emd="누리동", main_lot="86", sub_lot="15", building="새봄빌라", floor="제4", ho="409", kind="등기부주소", lot="대전광역시 물결구 누리동 86-15")),
    ("대전 물결구 샛별동 77 솔밭빌 12호", dict(sido="대전광역시", emd="샛별동", main_lot="77", sub_lot="0", ho="12")),
    ("충남 바람시 햇살구 은빛동 903 꽃잎마을 제7동 제1102호", dict(sigungu="바람시 햇살구", emd="은빛동", building_dong="7", ho="1102")),
    ("전북특별자치도 바람군 구름면 산 5-61", dict(mountain="1", main_lot="5", sub_lot="61", lot="전북특별자치도 바람군 구름면 산 5-61")),
    ("대전광역시 물결구 달맞이로 8길 41", dict(is_road=True, building_no="41", main_lot=None, query="대전광역시 물결구 달맞이로8길 41", kind="도로명주소")),
    ("대전 물결구 달맞이로 1250", dict(is_road=True, building_no="1250")),
    ("대전 물결구 누리동 86-15", dict(kind="지번주소")),
    ("4771-2007-310258", dict(kind="등기고유번호")),
    ("대전 물결구 누리동 86-15 지하3호", dict(ho="3")),
    ("   ", dict(kind=None, warnings=["빈 입력"])),
])
def test_parse(spark, text, expected):
    row = parse(spark, text)
    assert {k: row[k] for k in expected} == expected


def test_filter_on_parsed_columns_plans(spark):
    """A filter on parsed parts must not blow the plan up when it is pushed down."""
    rows = A.parse_address(spark.createDataFrame([("대전 물결구 누리동 1",)], "q string"), "q")
    assert rows.where(F.col("parsed.main_lot") == "1").where(A.input_class(F.col("q"), F.col("parsed")) == "지번주소").count() == 1


def test_strip(value):
    assert value(A.strip_detail(F.col("q")), q="대전 물결구 누리동 86-15 7동 1102호") == "대전 물결구 누리동 86-15"
    tail = A.strip_unit_tail(F.col("q"), F.col("d"), F.col("h"))
    assert value(tail, q="물결구 한빛오피스텔 7동 1102호", d="7", h="1102") == "물결구 한빛오피스텔"
    assert value(tail, q="물결구 한빛오피스텔", d="7", h="1102") == "물결구 한빛오피스텔"

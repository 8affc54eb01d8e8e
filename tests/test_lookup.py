import json

import pytest

from parcelwise.plans import lookup as P
from parcelwise.sources import responses as R

UNIT = "pnu string, year string, dong string, floor string, ho string, price bigint, name string, type string"
OFFICE = "pnu string, ldcode string, building string, dong string, floor string, ho string, prvuse double, share double, price bigint, year string"


def address(code, main, sub, road="가상로 1", kind="1", emd="가상동"):
    return {"admCd": code, "mtYn": "0", "lnbrMnnm": main, "lnbrSlno": sub, "siNm": "대전", "sggNm": "가구", "emdNm": emd, "jibunAddr": f"{emd} {main}-{sub}", "roadAddr": road, "bdKdcd": kind, "hstryYn": "0"}


def body(*items, error="0"):
    return json.dumps({"results": {"common": {"errorCode": error, "errorMessage": "오류"}, "juso": list(items)}}, ensure_ascii=False)


@pytest.fixture(scope="module")
def found(spark):
    landed = spark.createDataFrame(
        [
            ("대전광역시 물결구 누리동 86-15", body(address("4771025300", "86", "15"))),
            ("대전광역시 물결구 누리동 12-4", body(address("4771025300", "12", "4"))),
            ("별빛동 41", body(address("2717012200", "41", "0"), address("2920011800", "41", "0"))),
            ("대전광역시 가구 물빛동 905", body(address("3023013100", "905", "0", "은하대로 77"), address("3023013100", "905", "0", "은하대로 77 (별칭)"))),
        ],
        "query string, body string",
    )
    docs = json.dumps({"documents": [{"address": {"b_code": "4771025300", "mountain_yn": "N", "main_address_no": "86", "sub_address_no": "15", "address_name": "누리동 86-15"}}]})
    second = spark.createDataFrame([("대전광역시 바람구 가상동 9", docs)], "query string, body string")
    units = [("4771025300100860015", y, "", "4", "409", p, "새봄빌라", "다세대") for y, p in (("2026", 131_500_000), ("2025", 126_000_000))]
    units += [("3023013100109050000", "2026", d, "1", h, 310_000_000, "단지", "아파트") for d in ("7", "8") for h in ("21", "1102")]
    office = [("4771025300100120004", "4771025300", "타워", "1", "5", "512", 33.5, 14.25, p, y) for y, p in (("2026", 1_730_000), ("2025", 1_815_000))]
    sources = P.Sources(
        spark.createDataFrame(units, UNIT), spark.createDataFrame(office, OFFICE), R.decode_primary(landed), R.decode_secondary(second),
        spark.createDataFrame([("47712007310258", "대전 물결구 누리동 86-15 새봄빌라 제409호")], "register_number string, address string"),
    )
    requests = [
        (1, "대전 물결구 누리동 86-15 새봄빌라 제409호", None, None, None), (2, "대전 물결구 누리동 12-4 타워 512호", None, None, None),
        (3, "별빛동 41", None, None, None), (4, "대전 가구 물빛동 905", None, None, None), (5, "대전 가구 물빛동 905", "7", "1102", None),
        (6, "9999-2007-310258", None, None, None), (7, "", None, None, None), (8, "아무 글", None, "409", "4771025300100860015"),
        (9, "대전 바람구 가상동 9 제409호", None, None, None), (10, "대전광역시 물결구 달맞이로 8길 41", None, None, None), (11, "4771-2007-310258", None, "409", "4771025300100860015"),
    ]
    rows = spark.createDataFrame(requests, "request_id bigint, q string, dong string, ho string, pnu string")
    return {r["request_id"]: r for r in P.lookup(rows, sources, "2026", "2025").collect()}


def test_every_request_is_answered(found):
    assert sorted(found) == list(range(1, 12))


def test_villa(found):
    row = found[1]
    assert (row["pnu"], row["ho"], row["price_last"], row["price_this"], row["price_delta"]) == ("4771025300100860015", "409", 126_000_000, 131_500_000, 5_500_000)
    assert (row["status"], row["confidence_score"], row["confidence_grade"]) == ("SUCCESS", 83, "B")
    states = {c["key"]: c["state"] for c in row["checks"]}
    assert states == {"address": "PASS", "unit": "PASS", "price": "PASS", "compare": "PASS", "registry": "SKIP"}


def test_office_unit(found):
    row = found[2]
    assert (row["property_type"], row["price_this"], row["price_last"]) == ("오피스텔", 82_607_500, 86_666_250)
    assert (row["price_calc"]["unit_price_per_m2"], row["price_calc"]["total_area_m2"]) == (1_730_000, 47.75)


def test_ambiguous_and_collapsed_addresses(found):
    assert (found[3]["status"], found[3]["pnu"]) == ("NEEDS_ADDRESS_SELECTION", None)
    assert found[4]["status"] == "NEEDS_UNIT_SELECTION" and found[4]["pnu"] == "3023013100109050000" and found[4]["is_target"] is False
    assert (found[5]["price_this"], found[5]["status"]) == (310_000_000, "SUCCESS_CURRENT_ONLY")


def test_requests_without_an_address(found):
    assert found[6]["warnings"] == ["등기고유번호만 입력됨 - 보증DB 주소조회 필요"]
    assert found[7]["error"] and not found[7]["ok"]


def test_known_parcel_skips_the_ladder(found):
    assert (found[8]["price_this"], found[8]["confidence_grade"]) == (131_500_000, "C")
    assert found[11]["input_type"] == "등기고유번호" and {c["key"]: c["state"] for c in found[11]["checks"]}["registry"] == "PASS"


def test_fallback_provider_and_road_address(found):
    assert found[9]["pnu"] == "4771025300100860015" and "juso 결과 없음" in found[9]["warnings"]
    assert found[10]["pnu"] is None and not any("절삭검색" in w for w in found[10]["warnings"])


def test_errors_and_missing_pages_of_landed_answers(spark):
    def page(*homes, total=None):
        fields = [{"dongNm": d, "floorNm": "1", "hoNm": h, "pblntfPc": "90,000,000", "aphusNm": "단지", "aphusSeCodeNm": "연립"} for d, h in homes]
        return json.dumps({"apartHousingPrices": {"totalCount": total or len(homes), "field": fields}})

    failed = lambda code: json.dumps({"apartHousingPrices": {"resultCode": code}})
    parcels = {n: f"47710253001000{n}0000" for n in range(1, 7)}
    pages = [
        (parcels[1], "2026", 1, failed("INVALID_KEY")), (parcels[1], "2025", 1, failed("INVALID_KEY")), (parcels[2], "2026", 1, failed("SYSTEM_ERROR")),
        (parcels[3], "2026", 1, page(("1", "101"), ("1", "102"), total=4)), (parcels[3], "2026", 2, failed("INVALID_KEY")),
        (parcels[4], "2026", 1, page(("1", "101"))), (parcels[4], "2025", 1, failed("OVER_REQUEST_LIMIT")),
        (parcels[5], "2026", 1, failed("INVALID_KEY")), (parcels[5], "2026", 1, page(("1", "101"))), (None, "2026", 1, failed("INVALID_KEY")), (parcels[6], "2026", 1, None),
    ]
    prices = R.price_tables(spark.createDataFrame(pages, "pnu string, year string, page int, body string"))
    none = spark.createDataFrame([], "query string, body string")
    sources = P.landed_sources(prices, spark.createDataFrame([], OFFICE), R.decode_primary(none), R.decode_secondary(none))
    requests = spark.createDataFrame([(n, f"글 {n}", "1", "103" if n == 3 else "101", pnu) for n, pnu in parcels.items()], "request_id bigint, q string, dong string, ho string, pnu string")
    rows = {r["request_id"]: r for r in P.lookup(requests, sources, "2026", "2025").collect()}
    assert {n: r["status"] for n, r in rows.items()} == {
        1: "SOURCE_ERROR", 2: "NOT_FOUND", 3: "NEEDS_UNIT_SELECTION", 4: "SOURCE_ERROR", 5: "SUCCESS_CURRENT_ONLY", 6: "NOT_FOUND"}
    assert rows[1]["warnings"].count("인증 오류: INVALID_KEY") == 2 and "API 오류: SYSTEM_ERROR" in rows[2]["warnings"]
    assert any(w.startswith("★세대 일부만 조회됨: 2/4건") for w in rows[3]["warnings"])
    assert (rows[4]["price_this"], rows[5]["price_this"]) == (90_000_000, 90_000_000) and "해당 PNU 공시가격 없음" in rows[6]["warnings"]

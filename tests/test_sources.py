import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import listing as L
from parcelwise.operators import officetel as O
from parcelwise.sources import officetel_sheets, price_csv, responses, sinks

HEADER = "법정동코드,시도,시군구,읍면동,단지명,동,호,공동주택구분,전용 면적,공동주택가격"
ROWS = [
    '1153010700,서울특별시,구로구,개봉동,가,101,201,다세대,45.67,"100,000,000"',
    "1153010700,서울특별시,구로구,개봉동,나,101,202,아파트,60,100000001",
    "1153010700,서울특별시,구로구,개봉동,다,101,203,연립,abc,5000",
    "115,서울특별시,구로구,개봉동,라,101,204,연립,30,5000",
    "1153010700,서울특별시,구로구",
    "1144010700,서울특별시,마포구,가상동,마,1,1,,40,-7",
]


def write(tmp_path, name, lines, encoding):
    path = tmp_path / name
    path.write_bytes("\n".join(lines).encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949"])
def test_scan_and_accounting(spark, tmp_path, encoding):
    raw = price_csv.read_prices(spark, write(tmp_path, "p.csv", [HEADER, *ROWS], encoding))
    counts = L.row_accounting(L.classify_rows(raw)).collect()[0]
    assert (counts["total"], counts["kept"], counts["skipped"]) == (6, 2, 3)
    items = {r["name"]: r for r in L.listing_items(L.kept_rows(raw)).collect()}
    assert (items["가"]["price"], items["가"]["per_m2"], items["가"]["region"], items["가"]["area"]) == (100_000_000, round(100_000_000 / 45.67), "서울특별시 구로구", 45.67)
    assert (items["마"]["type"], items["마"]["price"]) == ("기타", -7)


def test_every_file_keeps_its_own_header(spark, tmp_path):
    write(tmp_path, "a [1].csv", ["법정동코드,단지명,면적,공시가격", "1153010700,가,46,5000"], "utf-8")
    write(tmp_path, "나.csv", ["공시가격\t면적\t단지명\t법정동코드", "6000\t47\t나\t1153010700"], "cp949")
    write(tmp_path, "empty.csv", [""], "utf-8")
    rows = {r["name"]: (r["area"], r["price"]) for r in price_csv.read_prices(spark, str(tmp_path)).collect()}
    assert rows == {"가": ("46", "5000"), "나": ("47", "6000")}


def test_late_bytes_decide_the_encoding(spark, tmp_path):
    path = write(tmp_path, "p.csv", ["name,단지명,면적,공시가격".replace("단지명", "x"), *["a,b,1,2"] * 2000, "a,b,1,가"], "cp949")
    layouts = price_csv.file_layouts(spark, path)
    assert [x.encoding for x in layouts] == ["cp949"]
    header = ["단지명,면적,공시가격", "가,1,2"]
    raw = price_csv.read_prices(spark, write(tmp_path, "q.csv", header, "cp949"), encoding="cp949")
    assert raw.agg(price_csv.undecoded(raw)).first()[0] == 0
    (tmp_path / "r.csv").write_bytes("\n".join(header).encode("utf-8") + b"\nb\xff,3,4")
    raw = price_csv.read_prices(spark, str(tmp_path / "r.csv"), encoding="utf-8")
    assert (raw.agg(price_csv.undecoded(raw)).first()[0], raw.count()) == (1, 2)


def test_quoted_cells_run_over_lines(spark, tmp_path):
    lines = ["단지명,면적,공시가격", '"가', '나 ""다""",46,5000', "라,47,6000"]
    raw = price_csv.read_prices(spark, write(tmp_path, "p.csv", lines, "cp949"))
    assert sorted((r["name"], r["area"], r["price"], r["_short"]) for r in raw.collect()) == [('가\n나 "다"', "46", "5000", False), ("라", "47", "6000", False)]


@pytest.mark.parametrize("split", [16, 61, 1000, 1 << 20])
@pytest.mark.parametrize("encoding,end", [("utf-8", "\n"), ("cp949", "\r\n")])
def test_cells_over_lines_are_read_by_many_tasks(spark, tmp_path, split, encoding, end):
    rng = random.Random(split)
    texts = ["가", "나,다", 'q"q', "줄\n줄", "\n\n", '"', '",\n"', "", 'x\n"y",\nz', "tail\n"]
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", encoding=encoding, newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["단지명", "면적", "공시가격"])
            for i in range(60):
                if i % 7 == 0:
                    f.write(end)
                f.write(f'5" {i},x"y,1{end}' if i % 5 == 0 else "")
                out.writerow([rng.choice(texts), f"{i}", rng.choice(texts)])
    with open(tmp_path / "a.csv", "ab") as f:
        f.write('"끝나지 않는\n칸,1'.encode(encoding))
    layouts = price_csv.file_layouts(spark, str(tmp_path))
    (layout, paths), = layouts.items()
    assert layout.multi_line
    whole = spark.read.schema("c0 string, c1 string, c2 string").options(
        header=True, multiLine=True, quote='"', escape='"', encoding=price_csv.CHARSETS[layout.encoding]).csv(paths)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        lines = price_csv.scan(spark, paths, layout)
        got = Counter(tuple(r) for r in lines.drop("_short").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == Counter(tuple(r) for r in whole.collect()) and sum(got.values()) > 120


def test_no_file_with_a_header(spark, tmp_path):
    with pytest.raises(price_csv.MissingColumns):
        price_csv.read_prices(spark, write(tmp_path, "p.csv", [""], "utf-8"))


def test_header_variants():
    header = ["시도", " 읍면동 ", "동명", "공시 가격", "전용면적"]
    found = price_csv.guess_columns(header, price_csv.LISTING_ALIASES)
    assert (found["eupmyeondong"], found["dong"], found["price"]) == (" 읍면동 ", "동명", "공시 가격")
    assert price_csv.guess_columns(header, price_csv.LISTING_ALIASES, {"price": "시도"})["price"] == "시도"
    assert price_csv.guess_columns(header, price_csv.LISTING_ALIASES, {"price": "없음"})["price"] == "공시 가격"
    assert price_csv.choose_columns(["주택의 가격(원)", "전용면적(제곱미터)", "건물종류", "법정동"]) == {
        "housing_type": "건물종류", "area": "전용면적(제곱미터)", "price": "주택의 가격(원)", "dong": "법정동"}
    with pytest.raises(price_csv.MissingColumns):
        price_csv.require({"price": "가격"}, "listing", ["가격"])


def test_detection():
    assert price_csv.detect_encoding("가나".encode("cp949"), 1) == "cp949"
    assert price_csv.detect_encoding("가나".encode("utf-8"), 0) == "utf-8"
    assert price_csv.detect_encoding("가나".encode("utf-8-sig"), 3) == "utf-8-sig"
    assert price_csv.detect_delimiter("a\tb\tc,d") == "\t" and price_csv.detect_delimiter("a,b") == ","


def test_responses(spark):
    bodies = [
        '{"apartHousingPrices":{"totalCount":1,"fields":{"field":[{"hoNm":"1","pblntfPc":"1,000"}]}}}', '{"response":{"totalCount":"1","field":{"hoNm":"2","pblntfPc":"x"}}}',
        '{"totalCount":1,"fields":[{"hoNm":"3","pblntfPc":3}]}', '{"apartHousingPrices":{"resultCode":"INCORRECT_KEY"}}', '{"apartHousingPrices":{"totalCount":0}}',
    ]
    landed = spark.createDataFrame([("P", "2026", i + 1, b) for i, b in enumerate(bodies)], "pnu string, year string, page int, body string")
    decoded = responses.decode_price_bodies(landed)
    assert sorted((r["ho"], r["price"]) for r in responses.explode_units(decoded).collect()) == [("1", 1000), ("2", None), ("3", 3)]
    assert [r["error_code"] for r in decoded.orderBy("page").collect()] == [None, None, None, "INCORRECT_KEY", None]


def test_pages_stop_at_a_gap(spark):
    one = '{"apartHousingPrices":{"totalCount":9,"field":[{"hoNm":"1"}]}}'
    landed = spark.createDataFrame([("P", "2026", p, one) for p in (1, 2, 4)] + [("Q", "2026", 1, one)], "pnu string, year string, page int, body string")
    found = {r["pnu"]: (r["received"], r["expected"], r["complete"]) for r in responses.completeness(responses.decode_price_bodies(landed)).collect()}
    assert found == {"P": (2, 9, False), "Q": (1, 9, False)}


def test_sheets_and_upsert(spark, tmp_path):
    row = lambda no, kind, lot, ho, price: (no, kind, "d", "4771025300", "일반", lot, "32", "타워", None, "지상", "2", ho, price, "29.84", None)
    names = [f"c{i}" for i in range(15)]
    schema = ", ".join(f"{n} string" for n in names)
    sheet = spark.createDataFrame([row("1", "오피스텔", "12", "201", "10"), row("2", "상가", "12", "1", "10"), row("3", "오피스텔", "x", "2", "10")], schema)
    load = officetel_sheets.ingest([sheet, sheet.limit(0)], "2026", ["47"])
    assert tuple(load.accounting.collect()[0]) == (1, 1)
    assert [(r["pnu"], r["dong"], r["price"], r["share"]) for r in load.rows.collect()] == [("4771025300100120032", "", 10, None)]
    path = str(tmp_path / "table")
    sinks.upsert_officetel(spark, path, load.rows)
    sinks.upsert_officetel(spark, path, load.rows.withColumn("price", F.lit(11).cast("bigint")))
    sinks.upsert_officetel(spark, path, load.rows.withColumn("year", F.lit("2025")))
    stored = spark.read.parquet(path)
    assert sorted((str(r["year"]), r["price"]) for r in stored.collect()) == [("2025", 10), ("2026", 11)]
    assert sorted((str(r["year"]), r["rows"], r["parcels"]) for r in O.load_report(stored).collect()) == [("2025", 1, 1), ("2026", 1, 1)]


def test_more_than_twenty_pages_are_kept(spark):
    from pyspark.sql import functions as F

    from parcelwise.sources import responses as R

    schema = "pnu string, year string, page int, error_code string, total long, rows array<struct<stdrYear:string>>"
    pages = spark.createDataFrame([("1" * 19, "2026", n, None, 25, [("2026",)]) for n in range(1, 26)], schema)
    assert R.usable_pages(pages).agg(F.sum("got")).first()[0] == 25

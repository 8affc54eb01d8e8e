"""Input views derived from the driver tables.

The texts run unchanged in Spark and DuckDB, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOUSING_UNITS = """
SELECT lpad(CAST(11000 + s.s_nationkey * 10 AS STRING), 5, '0') AS code,
       concat('D', CAST(l.l_suppkey % 8 AS STRING)) AS dong,
       CASE l.l_returnflag WHEN 'A' THEN '아파트' WHEN 'N' THEN '연립' ELSE '다세대' END AS type,
       CASE s.s_nationkey % 3 WHEN 0 THEN '서울' WHEN 1 THEN '경기' ELSE '부산' END AS sido,
       l.l_quantity + 10 AS area,
       CAST(floor(l.l_extendedprice * 6000) AS BIGINT) AS price,
       l.l_orderkey, l.l_linenumber
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""

_PNU = "concat(CAST(1100000000 + l_suppkey AS STRING), '1', lpad(CAST(l_partkey % 100 AS STRING), 4, '0'), '0000')"

UNIT_PRICE = f"""
SELECT {_PNU} AS pnu, '2026' AS year,
       CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('제', CAST(101 + l_linenumber AS STRING), '동') END AS dong,
       CAST(1 + l_orderkey % 9 AS STRING) AS floor,
       concat(lpad(CAST(100 * (1 + l_orderkey % 9) + l_orderkey % 4 AS STRING), 4, '0'), '호') AS ho,
       CAST(floor(l_extendedprice * 6000) AS BIGINT) AS price,
       concat('단지', CAST(l_suppkey AS STRING)) AS name,
       CASE l_suppkey % 3 WHEN 0 THEN '아파트' WHEN 1 THEN '연립' ELSE '다세대' END AS type
FROM lineitem
UNION ALL
SELECT {_PNU}, '2025',
       CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(101 + l_linenumber AS STRING) END,
       CAST(1 + l_orderkey % 9 AS STRING),
       CAST(100 * (1 + l_orderkey % 9) + l_orderkey % 4 AS STRING),
       CAST(floor(l_extendedprice * 5820) AS BIGINT),
       concat('단지', CAST(l_suppkey AS STRING)),
       CASE l_suppkey % 3 WHEN 0 THEN '아파트' WHEN 1 THEN '연립' ELSE '다세대' END
FROM lineitem WHERE l_orderkey % 7 <> 0
"""

# One request per order.  The first line of the order names the parcel and the building; some
# requests ask for a unit that is not there, leave the building or the unit out, or use the raw
# spelling of the price table.
REQUESTS = """
SELECT o.o_orderkey AS request_id,
       concat(CAST(1100000000 + l.l_suppkey AS STRING), '1', lpad(CAST(l.l_partkey % 100 AS STRING), 4, '0'), '0000') AS pnu,
       CASE WHEN o.o_orderkey % 13 = 0 THEN '' WHEN o.o_orderkey % 17 = 0 THEN '999'
            WHEN o.o_orderkey % 5 = 0 THEN concat('제', CAST(101 + l.l_linenumber AS STRING), '동')
            ELSE CAST(101 + l.l_linenumber AS STRING) END AS dong,
       CASE WHEN o.o_orderkey % 11 = 0 THEN '9999' WHEN o.o_orderkey % 19 = 0 THEN ''
            WHEN o.o_orderkey % 5 = 0 THEN concat(lpad(CAST(100 * (1 + l.l_orderkey % 9) + l.l_orderkey % 4 AS STRING), 4, '0'), '호')
            ELSE CAST(100 * (1 + l.l_orderkey % 9) + l.l_orderkey % 4 AS STRING) END AS ho
FROM orders o JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_linenumber) AS l_linenumber
                    FROM (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber,
                                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey,
                                                    l_extendedprice, l_quantity, l_shipdate) AS rn FROM lineitem) t
                    WHERE rn = 1 GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""

OFFICETEL = f"""
SELECT {_PNU} AS pnu, CAST(1100000000 + l_suppkey AS STRING) AS ldcode, 'tower' AS building, '1' AS dong,
       CAST(1 + l_orderkey % 9 AS STRING) AS floor,
       CAST(100 * (1 + l_orderkey % 9) + l_orderkey % 4 AS STRING) AS ho,
       l_quantity AS prvuse, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax * 100 END AS share,
       CAST(floor(l_extendedprice * 20) AS BIGINT) AS price,
       CASE WHEN l_orderkey % 2 = 0 THEN '2026' ELSE '2025' END AS year
FROM lineitem WHERE l_returnflag = 'N'
"""

ADDRESSES = """
SELECT o_orderkey AS request_id,
       concat('서울 물결구 누리동 ', CAST(1 + o_custkey % 1999 AS STRING), '-', CAST(1 + o_orderkey % 99 AS STRING),
              ' 새봄빌라 제', CAST(1 + o_orderkey % 4 AS STRING), '층 제', CAST(100 * (1 + o_orderkey % 4) + o_custkey % 8 AS STRING), '호') AS q
FROM orders
"""

# Untyped price rows as a file would give them, with bad values of every kind.
RAW_PRICE_ROWS = """
SELECT CAST(l_orderkey AS STRING) AS row_id, CAST(l_linenumber AS STRING) AS line,
       CASE WHEN l_orderkey % 41 = 0 THEN '11' WHEN l_orderkey % 43 = 0 THEN 'x1530107' 
            ELSE concat(CAST(11000 + (l_suppkey % 25) * 10 AS STRING), '10', lpad(CAST(l_suppkey % 8 AS STRING), 3, '0')) END AS ldcode,
       CASE l_suppkey % 3 WHEN 0 THEN '서울특별시' WHEN 1 THEN '경기도' ELSE '부산광역시' END AS sido,
       concat('구', CAST(l_suppkey % 25 AS STRING)) AS sigungu,
       CASE WHEN l_orderkey % 37 = 0 THEN ' ' ELSE concat('D', CAST(l_suppkey % 8 AS STRING)) END AS eupmyeondong,
       concat('단지', CAST(l_suppkey AS STRING)) AS name,
       CAST(101 + l_linenumber AS STRING) AS dong,
       CAST(100 * (1 + l_orderkey % 9) + l_orderkey % 4 AS STRING) AS ho,
       CASE WHEN l_orderkey % 29 = 0 THEN '' WHEN l_returnflag = 'A' THEN '아파트' WHEN l_returnflag = 'N' THEN '연립주택' ELSE ' 다세대 ' END AS type,
       CASE WHEN l_orderkey % 23 = 0 THEN '' WHEN l_orderkey % 31 = 0 THEN '12f'
            WHEN l_orderkey % 47 = 0 THEN '-3.5' ELSE concat(CAST(CAST(l_quantity AS BIGINT) + 10 AS STRING), '.25') END AS area,
       CASE WHEN l_orderkey % 19 = 0 THEN 'N/A' WHEN l_orderkey % 53 = 0 THEN '-1,500'
            WHEN l_orderkey % 59 = 0 THEN '5e7' WHEN l_orderkey % 61 = 0 THEN '"70,000,000"'
            ELSE concat(CAST(CAST(floor(l_extendedprice * 6) AS BIGINT) AS STRING), ',000') END AS price
FROM lineitem
"""

# Address texts of the orders in their parts: lot n-m, floor f, unit h.
ADDRESS_PARTS = """
SELECT o_orderkey AS request_id, CAST(1 + o_custkey % 1999 AS STRING) AS n, CAST(1 + o_orderkey % 99 AS STRING) AS m,
       CAST(1 + o_orderkey % 4 AS STRING) AS f, CAST(100 * (1 + o_orderkey % 4) + o_custkey % 8 AS STRING) AS h,
       o_orderkey % 5 AS kind
FROM orders
"""

_LOT = "concat('서울 물결구 누리동 ', n, '-', m)"
_CUT = f"concat({_LOT}, ' 새봄빌라')"
_FULL = f"concat({_LOT}, ' 새봄빌라 제', f, '층 제', h, '호')"

# Landed search results: by kind the full text, the text without unit, the bare lot (two parcels),
# the other provider, or nothing is known.
PRIMARY_CANDIDATES = f"""
WITH a AS ({ADDRESS_PARTS}), c AS (
  SELECT {_FULL} AS query, 0 AS pos, n, m FROM a WHERE kind = 0
  UNION ALL SELECT {_CUT}, 0, n, m FROM a WHERE kind = 1
  UNION ALL SELECT {_CUT}, 1, n, m FROM a WHERE kind = 1
  UNION ALL SELECT {_LOT}, 0, n, m FROM a WHERE kind = 3
  UNION ALL SELECT {_LOT}, 1, n, CAST(CAST(m AS INT) + 100 AS STRING) FROM a WHERE kind = 3)
SELECT DISTINCT query, pos, '4771025300' AS adm_code, '0' AS mountain, n AS main_lot, m AS sub_lot, '서울특별시' AS sido, '물결구' AS sigungu,
       '누리동' AS emd, concat('서울특별시 물결구 누리동 ', n, '-', m) AS lot_address, concat('누리로 ', n, ' #', CAST(pos AS STRING)) AS road_address,
       CASE WHEN CAST(n AS INT) % 2 = 0 THEN '1' ELSE '0' END AS building_kind, CASE WHEN CAST(n AS INT) % 3 = 0 THEN '1' ELSE '0' END AS history,
       CAST(NULL AS STRING) AS error
FROM c
"""

SECONDARY_CANDIDATES = f"""
WITH a AS ({ADDRESS_PARTS})
SELECT DISTINCT {_FULL} AS query, 0 AS pos, '4771025300' AS adm_code, 'N' AS mountain, n AS main_lot, m AS sub_lot,
       concat('서울 물결구 누리동 ', n, '-', m) AS address_name, true AS has_address
FROM a WHERE kind = 2
"""

VIEWS = {
    "address_parts": ADDRESS_PARTS,
    "primary_candidates": PRIMARY_CANDIDATES,
    "secondary_candidates": SECONDARY_CANDIDATES,
    "housing_units": HOUSING_UNITS,
    "unit_price": UNIT_PRICE,
    "requests": REQUESTS,
    "officetel": OFFICETEL,
    "addresses": ADDRESSES,
    "raw_price_rows": RAW_PRICE_ROWS,
}

TABLES = ("lineitem", "orders", "supplier", "customer", "part", "nation", "region", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; driver tables enter as arguments, no temp view is left behind."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in text}
    for t in used:
        for head in ("FROM", "JOIN"):
            text = text.replace(f"{head} {t}", f"{head} {{{t}}}")
    return spark.sql(text, **used)


def with_views(body: str, *names: str) -> str:
    """Prefix an oracle text with the named views as common table expressions."""
    heads = ", ".join(f"{name} AS ({VIEWS[name]})" for name in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"

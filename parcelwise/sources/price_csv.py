"""Price files: encoding and delimiter detection, header aliases, tolerant CSV scan.

A path may name many files.  One native pass over all their lines (:func:`file_layouts`) tells each file's encoding
and whether quoted cells run over lines; the header is the file's own first line.  Files that agree are read in one
scan, the scans are joined by logical name.  All columns stay text, types are parsed later with the tolerant number
functions.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Column name aliases of the listing files.
LISTING_ALIASES = {
    "sido": ["시도", "시·도", "시도명", "광역시도"],
    "sigungu": ["시군구", "시·군·구", "시군구명"],
    "eupmyeondong": ["읍면동", "법정동", "읍면동명", "동리", "동명"],
    "jibun": ["지번", "번지"],
    "name": ["단지명", "공동주택명", "건물명", "아파트명"],
    "dong": ["동명", "동", "건물동"],
    "ho": ["호명", "호", "호수"],
    "type": ["공동주택구분", "주택유형", "구분", "유형"],
    "area": ["전용면적", "전용면적(㎡)", "면적", "전용"],
    "price": ["공동주택가격", "공시가격", "공동주택가격(원)", "가격", "공시가"],
    "ldcode": ["법정동코드", "지역코드", "법정동시군구코드"],
    "bdmgt": ["관리건축물대장PK", "건축물대장PK", "관리건축물대장pk"],
}

# Column name aliases of the statistics files.
STATS_ALIASES = {
    "sigungu": ["시군구", "시군구명", "시·군·구"],
    "eupmyeondong": ["읍면동", "법정동", "읍면동명", "동리", "동명", "법정동명"],
    "complex": ["단지명", "공동주택명", "건물명"],
    "type": ["주택유형", "공동주택구분", "유형", "주택구분"],
    "area": ["전용면적", "전용면적(㎡)", "면적"],
    "price": ["공시가격", "공동주택가격", "공시가격(원)", "가격"],
    "ldcode": ["법정동코드", "지역코드", "법정동시군구코드"],
}

# Names and fallback words of the study members.
STUDY_COLUMNS = {
    "housing_type": (["공동주택구분명", "주택유형", "공동주택구분", "건물종류"], ["구분", "명"]),
    "area": (["전용면적", "전용면적(㎡)", "전용면적(m2)"], ["전용", "면적"]),
    "price": (["공동주택가격", "공시가격", "공동주택가격(원)"], ["주택", "가격"]),
    "sido": (["시도", "시도명"], ["시도"]),
    "sigungu": (["시군구", "시군구명"], ["시군구"]),
    "dong": (["법정동", "법정동명"], ["법정동"]),
    "dong_code": (["법정동코드"], ["법정동", "코드"]),
}

REQUIRED = {"listing": ("price", "area"), "stats": ("eupmyeondong", "price"), "study": ("housing_type", "area", "price", "dong")}
#: What a decoder puts where bytes do not fit the encoding.
REPLACED = "\ufffd"

# Python encoding name -> charset name of the CSV reader.
CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "MS949", "euc-kr": "EUC-KR"}
BOM = b"\xef\xbb\xbf"


class MissingColumns(ValueError):
    """A file lacks a column the job cannot do without."""


@dataclass(frozen=True)
class Layout:
    """How the files of one scan are read."""

    encoding: str
    delimiter: str
    header: tuple[str, ...]
    multi_line: bool


def detect_encoding(head: bytes, broken_lines: int) -> str:
    """UTF-8 if no line of the whole file breaks it, else cp949, which holds all of EUC-KR."""
    if head.startswith(BOM):
        return "utf-8-sig"
    return "cp949" if broken_lines else "utf-8"


def detect_delimiter(header: str) -> str:
    return "\t" if header.count("\t") > header.count(",") else ","


def _first_line(spark: SparkSession, file: str) -> tuple[str, bytes]:
    """(path, first line that is not blank) of a file, named as ``_metadata.file_path`` names it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "ISO-8859-1"))
    try:
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
    finally:
        reader.close()
    return path.toString(), (line or "").encode("latin-1")


def _odd_quotes(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1


def file_layouts(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None) -> dict[Layout, list[str]]:
    """Files below ``path`` by layout; a given ``encoding`` is taken as it is.

    One pass counts, per file, lines that are no UTF-8 and lines with an odd number of quotes; only a file with such a
    line can hold a cell that runs over lines, and goes through :func:`records`.  The driver sees one row and one
    header line per file.  Files without lines are left out.
    """
    value = F.col("value")
    found = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count_if(~F.is_valid_utf8(value)).alias("broken"), F.count_if(_odd_quotes(value)).alias("open")
    )
    out: dict[Layout, list[str]] = {}
    for row in sorted(found.collect()):
        file, head = _first_line(spark, row["file"])
        if not head:
            continue
        chosen = encoding or detect_encoding(head, row["broken"])
        first = head.removeprefix(BOM).decode(chosen, "replace")
        delimiter = detect_delimiter(first)
        layout = Layout(chosen, delimiter, tuple(next(csv.reader([first], delimiter=delimiter))), row["open"] > 0)
        out.setdefault(layout, []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", file))
    return out


def _squeezed(name: str) -> str:
    return name.strip().replace(" ", "")


def guess_columns(header: Sequence[str], aliases: Mapping[str, Sequence[str]], overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Logical name -> header name: an override that exists wins, else the first alias present."""
    present = {_squeezed(h): h for h in reversed(header)}
    chosen = {}
    for logical, names in aliases.items():
        wanted = (overrides or {}).get(logical)
        for name in ([wanted] if wanted else []) + list(names):
            if _squeezed(name) in present:
                chosen[logical] = present[_squeezed(name)]
                break
    return chosen


def _letters(name: str) -> str:
    return re.sub(r"[^0-9a-zA-Z가-힣]", "", name).lower()


def choose_columns(header: Sequence[str]) -> dict[str, str]:
    """Study variant: exact names first, then the first header that contains all words."""
    present = {_letters(h): h for h in header}
    chosen = {}
    for logical, (names, words) in STUDY_COLUMNS.items():
        exact = [present[_letters(n)] for n in names if _letters(n) in present]
        loose = [h for h in header if all(_letters(w) in _letters(h) for w in words)]
        if exact or loose:
            chosen[logical] = (exact or loose)[0]
    return chosen


def require(chosen: Mapping[str, str], kind: str, header: Sequence[str]) -> None:
    missing = [c for c in REQUIRED[kind] if c not in chosen]
    if missing:
        raise MissingColumns(f"columns not found: {missing}; header: {list(header)}")


def _ends_open(line: Column, delimiter: str, opened: bool) -> Column:
    """Whether a quoted cell is open after ``line``, given whether one was before it.

    A quote opens a cell only at the cell's start; elsewhere in an unquoted cell it is text.
    """
    step = lambda is_open, piece: F.when(is_open, ~_odd_quotes(piece)).otherwise(piece.startswith('"') & _odd_quotes(piece))
    return F.when(F.contains(line, F.lit('"')), F.aggregate(F.split(line, re.escape(delimiter)), F.lit(opened), step)).otherwise(F.lit(opened))


def _turned(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add what the rows before each row (inside ``keys``) do to the state 0 (closed) or 1 (open): see :func:`_state`.

    A row either sets the state (``_set`` is 0 or 1), or turns it (``_turn`` is 1), or leaves it.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_turns", F.coalesce(F.sum("_turn").over(before), F.lit(0)))
    return rows.withColumn("_fixed", F.last(F.col("_set") - F.col("_turns"), ignorenulls=True).over(before))


def _state(entry: Column) -> Column:
    return F.pmod(F.coalesce(F.col("_fixed"), entry) + F.col("_turns"), F.lit(2))


def records(spark: SparkSession, paths: Sequence[str], delimiter: str) -> DataFrame:
    """Records of files whose quoted cells may run over lines, ``value`` as read, without each file's header.

    Files are split at any byte.  Every line either sets, turns or leaves the state "inside a quoted cell"; these
    effects compose, so one small row per split (its effect, and how many records start in it for either state before
    it) gives the state every split begins with.  Lines are then told apart inside their split, and only lines of
    records that have several are grouped.  Lines end with a line feed, a carriage return before it belongs to the end;
    blank lines between records are dropped.  A cell that never closes runs to the end of its file.
    """
    keys = ["_file", "_split"]
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line")
    )
    after = [_ends_open(value, delimiter, opened).cast("int") for opened in (False, True)]
    lines = lines.withColumn("_blank", F.rtrim(value, F.lit(" \t\r")) == "").withColumn("_after0", after[0]).withColumn("_after1", after[1])
    lines = lines.withColumn("_set", F.when(F.col("_after0") == F.col("_after1"), F.col("_after0")))
    lines = _turned(lines.withColumn("_turn", (F.col("_after0") > F.col("_after1")).cast("int")), keys, "_line")
    starts = lambda entry: (_state(entry) == 0) & ~F.col("_blank")

    splits = lines.groupBy(*keys).agg(
        F.sum("_turn").alias("_turn"), F.max_by(F.col("_set") - F.col("_turns"), F.when(F.col("_set").isNotNull(), F.col("_line"))).alias("_last"),
        F.count_if(starts(F.lit(0))).alias("_starts0"), F.count_if(starts(F.lit(1))).alias("_starts1"),
    )
    splits = splits.withColumn("_set", F.pmod(F.col("_last") + F.col("_turn"), F.lit(2)))
    splits = splits.withColumn("_turn", F.when(F.col("_set").isNull(), F.col("_turn") % 2).otherwise(0))
    of_file = Window.partitionBy("_file")
    splits = _turned(splits, ["_file"], "_split").withColumn("_entry", _state(F.lit(0)))
    own = F.when(F.col("_entry") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    begun = F.when(own > 0, F.struct(F.col("_split").alias("split"), own.alias("n")))
    earlier = of_file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        *keys, "_entry", F.last(begun, ignorenulls=True).over(earlier).alias("_running"), F.min(F.when(own > 0, F.col("_split"))).over(of_file).alias("_head")
    )

    told = lines.join(splits, keys).withColumn("_open", _state(F.col("_entry")) == 1).withColumn("_first", starts(F.col("_entry")))
    told = told.where(F.col("_open") | F.col("_first"))
    upto = Window.partitionBy(*keys).orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("_n", F.count_if("_first").over(upto))
    record = F.when(F.col("_n") > 0, F.struct(F.col("_split").alias("split"), F.col("_n").alias("n"))).otherwise(F.col("_running"))
    told = told.withColumn("_record", record).where((F.col("_record.split") != F.col("_head")) | (F.col("_record.n") != 1))
    alone = F.col("_first") & (F.col("_after0") == 0)
    parts = told.where(~alone).groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_split", "_line", "value"))).alias("_parts"))
    joined = parts.select(F.array_join(F.col("_parts.value"), "\n").alias("value"))
    return told.where(alone).select("value").unionAll(joined).select(F.rtrim("value", F.lit("\r")).alias("value"))


def scan(spark: SparkSession, paths: Sequence[str], layout: Layout) -> DataFrame:
    """All columns as text under positional names ``c0..``; ``_short`` marks rows with missing cells.

    cp949 needs ``spark.sql.legacy.javaCharsets=true``; bytes that do not fit are replaced, which files with cells over
    lines owe to ``spark.sql.legacy.codingErrorAction=true`` (see ``session.configure``).
    """
    names = [f"c{i}" for i in range(len(layout.header))]
    schema = ", ".join(f"{n} string" for n in names) + ", _bad string"
    options = {"sep": layout.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    charset = CHARSETS.get(layout.encoding, layout.encoding)
    if layout.multi_line:
        text = F.decode(F.col("value").cast("binary"), charset)
        rows = records(spark, paths, layout.delimiter).select(F.from_csv(text, schema, options).alias("r")).select("r.*")
    else:
        # Header names are irregular, the schema is enforced by position.
        rows = spark.read.schema(schema).options(header=True, enforceSchema=True, encoding=charset, **options).csv(list(paths))
    return rows.select(*names, (F.col("_bad").isNotNull() & F.col(names[-1]).isNull()).alias("_short"))


def read_prices(
    spark: SparkSession, path: str | Sequence[str], kind: str = "listing", encoding: str | None = None, overrides: Mapping[str, str] | None = None,
    layouts: Mapping[Layout, Sequence[str]] | None = None,
) -> DataFrame:
    """Price files with logical column names; only the mapped columns are read.

    Every file's own header counts; a logical column some files lack is null there.  ``layouts`` (of
    :func:`file_layouts`) saves the pass over the lines when it is known already.
    """
    parts = []
    for layout, files in (layouts or file_layouts(spark, path, encoding)).items():
        if kind == "study":
            chosen = choose_columns(layout.header)
        else:
            chosen = guess_columns(layout.header, LISTING_ALIASES if kind == "listing" else STATS_ALIASES, overrides)
        require(chosen, kind, layout.header)
        picked = [F.col(f"c{layout.header.index(source)}").alias(logical) for logical, source in chosen.items()]
        parts.append(scan(spark, files, layout).select(*picked, "_short"))
    if not parts:
        raise MissingColumns(f"no file with a header line below {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def undecoded(rows: DataFrame) -> Column:
    """Number of rows with text that did not fit the encoding, as an aggregate; a load should report it or stop."""
    return F.count_if(reduce(or_, (F.coalesce(F.contains(F.col(c), F.lit(REPLACED)), F.lit(False)) for c, t in rows.dtypes if t == "string")))


def read_members(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several study members with differing headers as one table; absent optional columns become ''."""
    rows = read_prices(spark, list(paths), "study").drop("_short")
    optional = [c for c in ("sido", "sigungu", "dong_code")]
    rows = rows.withColumns({c: F.lit("") for c in optional if c not in rows.columns})
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in optional})

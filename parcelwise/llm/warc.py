"""Web archive files: a writer with revisit records and a splittable reader.

Writer: one gzip member per record.  The digest of every payload is counted by Spark first; of equal payloads of at
least ``least_revisit`` bytes the smallest page id is written as ``response`` and the others as ``revisit`` records that
refer to it and carry no payload.  File names carry the attempt and only files in the returned manifest count, so a
task that runs again leaves nothing wrong behind.

Reader: files are cut into byte ranges without looking into them.  A task scans its range for the gzip magic and
takes a candidate as a member only if it decodes to a record header whose lengths fit; it owns the records that
start inside its range and reads past its end to finish the last one.  After a record the next candidate is looked
for behind it, so bytes inside a member are never taken for a start.

Edge cases: null html is an empty payload; a null page id is written as ``none`` and counts as the largest; rows that
repeat the smallest id of equal payloads are responses all; a null url gives no target header; an empty table
gives no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh_folder, open_folder, prepare, read_table, stored

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 100
SPLIT_BYTES = 4 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_READ = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str | None = None, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write every row; gives the manifest (uri, n_bytes, n_records)."""
    spark = prepare(pages.sparkSession)
    folder = folder or fresh_folder(spark, "warc")
    rows = pages.select(column(pages, "page_id", "bigint").alias("page_id"), column(pages, "url", "string").alias("url"),
                        F.coalesce(column(pages, "html", "binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    digests = rows.filter(F.octet_length("payload") >= least_revisit).select("digest", "page_id")
    # Only digests that occur again, one row each; Spark broadcasts them if their measured size allows.
    first = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1 and first is not null").select("digest", "first")
    marked = rows.join(stored(first, "warc-first"), "digest", "left").withColumn(
        "refers_to", F.when((F.octet_length("payload") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                member = record(*row)
                out.write(member)
                size += len(member)
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([count])], ["uri", "n_bytes", "n_records"])

    return stored(marked.mapInArrow(run, "uri string, n_bytes bigint, n_records bigint"), "warc-manifest")


class Member:
    """Decodes a gzip member step by step from a source of bytes."""

    def __init__(self, source, at: int):
        self.source, self.at, self.decoder = source, at, zlib.decompressobj(31)
        self.out = b""

    def until(self, done) -> bool:
        """Decode until ``done(out)``; False if the bytes are no gzip member."""
        while not done(self.out):
            if self.decoder.eof:
                return False
            chunk = self.source.read_at(_READ, self.at)
            if not chunk:
                return False
            self.at += len(chunk)
            try:
                self.out += self.decoder.decompress(chunk)
            except zlib.error:
                return False
        return True

    def finish(self) -> int | None:
        """Position behind the member, or None if it is damaged."""
        if not self.until(lambda _: self.decoder.eof):
            return None
        return self.at - len(self.decoder.unused_data)


def read_member(source, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(header fields, block, position behind) of the record that starts at a byte, or None if none does."""
    member = Member(source, at)
    if not member.until(lambda out: len(out) >= 5) or not member.out.startswith(b"WARC/"):
        return None
    if not member.until(lambda out: b"\r\n\r\n" in out):
        return None
    head, _, _ = member.out.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    end = member.finish()
    start = len(head) + 4
    size = int(fields["content-length"])
    if end is None or len(member.out) != start + size + 4 or not member.out.endswith(b"\r\n\r\n"):
        return None
    return fields, member.out[start : start + size], end


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, block) of the records that start in [start, end)."""
    at = start
    while at < end:
        window = source.read_at(min(_READ, size - at), at)
        hit = window.find(MAGIC)
        if hit < 0:
            if at + len(window) >= size:
                return
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        got = read_member(source, at)
        if got is None:
            at += 1
            continue
        fields, block, behind = got
        yield at, fields, block
        at = behind


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(uri, n_bytes, start): one row per byte range of (uri, n_bytes)."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    return files.select("uri", "n_bytes", F.explode(starts).alias("start"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(uri, n_bytes) of archives under a path, by Spark's own listing (contents are not read)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("length").alias("n_bytes"))


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(uri, position, record_type, record_id, target_uri, payload, payload_bytes, payload_digest, refers_to)."""
    spark = prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for uri, size, start in zip(*(batch.column(c).to_pylist() for c in ("uri", "n_bytes", "start"))):
                system, path = _open(uri)
                with system.open_input_file(path) as source:
                    for position, fields, block in records_in(source, size, start, min(size, start + split_bytes)):
                        held.append((uri, position, *_row(fields, block)))
                        weight += len(block)
                        if weight > 8 << 20:
                            yield _batch(held)
                            held, weight = [], 0
        if held:
            yield _batch(held)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return splits(files, split_bytes).repartition(parts).mapInArrow(run, _SCHEMA)


_SCHEMA = "uri string, position bigint, record_type string, record_id string, target_uri string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    folder, _, name = uri.rpartition("/")
    system, path = open_folder(folder)
    return system, f"{path}/{name}"


def _row(fields: dict[str, str], block: bytes) -> tuple:
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "revisit":
        size, digest = int(fields.get("x-payload-length", 0)), fields.get("warc-payload-digest", "").rpartition(":")[2]
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), payload, size, digest, fields.get("warc-refers-to")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])


def op4_warc(spark, sf_dir: str) -> DataFrame:
    found = read(write(read_table(spark, sf_dir, "pages")))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS x FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY x) END AS first FROM d)
SELECT page_id, n AS payload_bytes, x AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""}

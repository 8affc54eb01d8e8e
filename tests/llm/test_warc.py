import hashlib
import os

import pytest

from parcelwise.llm import warc as W


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def pages():
    big = "<p>" + "é" * 60
    out = [(9, "http://a/1", big), (4, "http://a/\r\nX: y", big), (7, None, big), (1, "u", None), (2, "u", ""), (3, "u", "short"), (5, "u", "short"), (None, "n", big), (None, "m", "only null " * 20), (None, "m", "only null " * 20)]
    return out + [(20, "x", "d" * 100), (21, "x", "d" * 100), (20, "x", "d" * 100), (30, "y", "e" * 99), (31, "y", "e" * 99), (40, "z", os.urandom(400_000).hex())]


def want(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        first = min(same) if same and len(payload) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [97, 5000, 4 << 20])
def test_round_trip(spark, split):
    rows = pages()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    number = lambda s: None if s in (None, "<urn:page:none>") else int(s[10:-1])
    got = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in W.read(W.write(docs), split).collect()]
    assert sorted(got, key=str) == want(rows)


def test_every_range_owns_its_own_records():
    members = [W.record(n, f"http://x/{n}", bytes([n]) * (n * 37), "0", 1 if n % 3 == 0 and n else None) for n in range(12)]
    data = b"".join(members)
    whole = [(at, f["warc-record-id"]) for at, f, _ in W.records_in(Bytes(data), len(data), 0, len(data))]
    assert [i for _, i in whole] == [f"<urn:page:{n}>" for n in range(12)]
    for step in (1, 50, 333):
        cut = [(at, f["warc-record-id"]) for s in range(0, len(data), step) for at, f, _ in W.records_in(Bytes(data), len(data), s, min(len(data), s + step))]
        assert cut == whole


def test_false_starts_are_passed_over():
    member = W.record(1, "u", b"x" * 300, "0", None)
    noise = W.MAGIC + b"\0\0\0\0\0\0\3junk" + W.zlib.compress(b"WARC/1.1 not a record")
    import gzip

    data = noise + gzip.compress(b"WARC/1.1\r\nno colon\r\n\r\n") + member + gzip.compress(b"other") + member[:40]
    assert [f["warc-record-id"] for _, f, _ in W.records_in(Bytes(data), len(data), 0, len(data))] == ["<urn:page:1>"]


def test_files_by_listing(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(W.record(3, "u", b"abc", "0", None))
    got = W.read(W.list_files(spark, str(tmp_path))).collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("<urn:page:3>", b"abc")]


def test_empty(spark):
    assert W.read(W.write(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []

import hashlib
import random

import pytest

from parcelwise.llm import suffix_dedup as S


def brute(texts, length):
    """Every window of every text in one dictionary."""
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for n, body in enumerate(bodies):
        for i in range(len(body) - length + 1):
            seen.setdefault(body[i : i + length], []).append((n, i))
    gone = [bytearray(len(b)) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for n, i in places:
                gone[n][i : i + length] = b"\1" * length
    out = []
    for body, marks in zip(bodies, gone):
        spans = sum(1 for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1]))
        out.append((len(body), sum(marks), spans, hashlib.sha256(bytes(c for c, m in zip(body, marks) if not m)).hexdigest()))
    return out


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    near = list(text(120))
    out = [None, "", "short", "x" * 450, "ab" * 300, passage, passage, passage[:198], text(80)]
    out += [text(rng.randint(0, 50)) + passage[rng.randint(0, 40) : rng.randint(150, 350)] + text(rng.randint(0, 50)) for _ in range(25)]
    out += [other + text(5) + other, text(30) + other[10:230]]
    for _ in range(12):
        copy = near[:]
        copy[rng.randrange(len(copy))] = "#"
        out.append("".join(copy))
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame([(n, t, "z", 1) for n, t in enumerate(texts)], "doc_id long, text string, body string, pos int")
    rows = {r.doc_id: r for r in S.cut(docs, **options).collect()}
    out = []
    for n in range(len(texts)):
        spans = rows[n].removed
        out.append((rows[n].n_bytes, sum(s.high - s.low for s in spans), len(spans), hashlib.sha256(bytes(rows[n].kept)).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_group": 3}])
def test_equals_brute_force(spark, options):
    given = texts()
    assert run(spark, given, **options) == brute(given, 200)


def test_short_windows_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 700)
    monkeypatch.setattr(S, "CHUNK_ROWS", 5)
    monkeypatch.setattr(S, "RUN_ROWS", 40)
    given = texts()
    assert run(spark, given, length=40, prefix=9) == brute(given, 40)


def test_repeated_rows_and_null_ids(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    docs = spark.createDataFrame([(None, text), (None, text), (None, "other"), (1, None)], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.n_bytes, bytes(r.kept)) for r in S.cut(docs).collect())
    assert rows == [(False, 0, b""), (True, 5, b"other"), (True, 300, b""), (True, 300, b"")]


def test_empty_table(spark):
    assert S.cut(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merge_is_sorted_with_common_prefixes():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30))) for _ in range(5)]
    meta = {name: S.np.zeros(0) for name, _ in S._META}
    coded = []
    for keys in runs:
        blob = S.encode_run(keys, {name: S.np.arange(len(keys)) for name in meta})
        coded.append(S.decode_run(blob)[:3])
    got = list(S.merge_runs(coded))
    assert [g[0] for g in got] == sorted(k for r in runs for k in r)
    for (a, *_), (b, same, *_) in zip(got, got[1:]):
        assert same == S.common_prefix(a, b, 0)

import hashlib
import random
import zlib

import pytest

from parcelwise.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, source, lang, n_chars, text = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """Root, and for every node the others of its runs, level by level."""
    where, others = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(where):
            low = i - i % 8
            others[k].append((nodes[low:i], nodes[i + 1 : low + 8]))
            where[k] = i // 8
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], others


def spelled(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts.append((mine, *climb([leaf(r) for r in mine])))
    root, top = climb([subroot for _, subroot, _ in parts])
    out = []
    for (mine, subroot, others), last in zip(parts, top):
        for row, steps in zip(mine, others):
            steps = steps + last
            struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, lower=struck)
            for left, right in steps:
                node = h("".join(left) + node + "".join(right))
            out.append((row[0], leaf(row), subroot, root, h("".join("".join(a) + "".join(b) for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def manifest(spark, rows, folder):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, at int")
    frame.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in M.op11_merkle_manifest(spark, str(folder)).collect()), key=str)


def table(sizes, seed=1):
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for lang, count in sizes.items():
        for _ in range(count):
            doc_id += rng.randint(1, 3)
            rows.append((doc_id, rng.choice(["web", None, "Bücher"]), lang, rng.randint(0, 99), rng.choice(["Some Text", "", None, "ÄÖ lower", f"Doc {doc_id}"])))
    return rows


# Below, at and above full runs and blocks; ragged last blocks, and last groups of one.
@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 8, "de": 9, None: 1, "": 2}, {"en": 64, "de": 65, "fr": 63}, {f"l{i:02}": 1 + i % 3 for i in range(70)}, {"en": 600, "de": 73, None: 145},
])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(M, "BLOCK_LEVELS", 1)  # many blocks, so the exchange takes up to three rounds
    rows = table(sizes)
    assert manifest(spark, rows, tmp_path) == spelled(rows)


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    rows = table({"en": 30, "de": 3})
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "X"), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "B"), (5, "s", "en", 1, "A"), (7777, "s", "en", 1, "Long Ü " * 100_000)]
    assert manifest(spark, rows, tmp_path) == spelled(rows)


def test_whole_blocks_of_production_size(spark, tmp_path):
    rows = table({"en": 1100, "de": 513})
    got = manifest(spark, rows, tmp_path)
    assert got == spelled(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_empty(spark, tmp_path):
    assert manifest(spark, [], tmp_path) == []


def test_stored_blocks_hold_no_paths(spark):
    rows = table({"de": 1100})
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    held = M.blocks(M.positions(M.leaves(docs), ["doc_id", "leaf"], "ordered"))
    assert held.count() == 3 and "path" not in held.schema.simpleString()
    width = sum(len(str(r)) for r in held.collect())
    assert width < 500 * len(rows)

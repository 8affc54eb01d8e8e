import random

import pytest

from parcelwise.llm import mixing as M


def levels(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(order)}
    cap = {s: 3.0 * sizes[s] for s in sizes}
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if target[s] + share * weight[s] >= cap[s]}
        if not full:
            for s in free:
                target[s] += share * weight[s]
            break
        for s in full:
            target[s] = cap[s]
        left = sum(sizes.values()) - sum(target[s] for s in sizes if s not in free or s in full)
        free -= full
        for s in free:
            target[s] = 0.0
    return target


def rows(seed=1, count=400):
    rng = random.Random(seed)
    out = []
    for n in range(count):
        source = rng.choice(["hot"] * 6 + ["a", "é", "Z", None, "tiny"]) if n % 50 else "tiny"
        size = 0 if n % 23 == 0 else rng.randint(1, 300) if source != "tiny" else 2
        out.append((n, " ".join(["w"] * size) if size or n % 2 else None, source, "x"))
    return out + [out[7], out[7], (None, "no id here", "a", "x")]


def mixed(spark, given):
    return M.taken_words(M.pieces(spark.createDataFrame(given, "doc_id long, text string, source string, key string"))).collect()


def test_targets_sizes_and_takings(spark):
    given = rows()
    got = mixed(spark, given)
    words = lambda t: len((t or "").split())
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, words(r[1])) for r in given)
    sizes = {}
    for _, t, s, _ in given:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = levels(sizes)
    source_of = {(r[0] if r[0] is not None else -1): r[2] for r in given}
    took = dict.fromkeys(sizes, 0)
    for r in got:
        source = source_of[r.doc_id if r.doc_id is not None else -1]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        took[source] += r.taken
    block = M.block_words(sum(sizes.values()), len(sizes))
    for s in sizes:
        assert abs(took[s] - want[s]) <= 12 * block


def test_every_source_ends_at_its_target(spark):
    rng = random.Random(8)
    given = [(n, " ".join(["w"] * rng.randint(2000, 4000)), rng.choice("ab"), "x") for n in range(200)]
    given += [(1000 + n, "few words here", f"tiny{n}", "x") for n in range(8)] + [(2000, " ".join(["w"] * 150), "z", "x")]
    source_of, sizes, took = {r[0]: r[2] for r in given}, {}, {}
    for _, t, s, _ in given:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert M.block_words(sum(sizes.values()), len(sizes)) > 3 * 3
    for r in mixed(spark, given):
        took[source_of[r.doc_id]] = took.get(source_of[r.doc_id], 0) + r.taken
    for s, want in levels(sizes).items():
        assert abs(took[s] - want) <= 0.5 + 1e-6


def test_reruns_and_partitions_agree(spark):
    given = rows(2)
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    first = sorted(map(key, mixed(spark, given)))
    assert first == sorted(map(key, mixed(spark, given[::-1])))


def test_pieces_tile_the_stream(spark):
    docs = spark.createDataFrame(rows(3), "doc_id long, text string, source string, key string")
    by_slot = {}
    for p in M.pieces(docs).filter("slot is not null").collect():
        by_slot.setdefault((p.key, p.slot), []).append(p.words)
    block = M.block_words(sum(len((t or "").split()) for _, t, _, _ in rows(3)), 6)
    full = sum(sum(w) == block for w in by_slot.values())
    assert all(sum(w) <= block for w in by_slot.values()) and full >= len(by_slot) - 6


def test_any_run_of_slots_is_mixed(spark):
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "key string, target double")
    slots = [r.key for r in M.schedule(shares, 4000, 3).orderBy("slot").collect()]
    for low in range(0, 4000, 400):
        run = slots[low : low + 400]
        assert [abs(run.count(k) / 400 - t) < 0.03 for k, t in (("a", 0.5), ("b", 0.3), ("c", 0.2))] == [True] * 3
    ranks = sorted(r.r for r in M.schedule(shares, 4000, 3).filter("key = 'b'").collect())
    assert ranks == list(range(len(ranks)))


def test_repeated_rows_of_the_mix(spark):
    docs = spark.createDataFrame(rows(4), "doc_id long, text string, source string, key string")
    out = M.repeat_to_targets(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(v for k, v in counts.items() if k not in (7, None)) <= 3


@pytest.mark.parametrize("given", [[], [(1, None, "a", "x"), (2, "", None, "x")]])
def test_no_words(spark, given):
    got = mixed(spark, given)
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * len(given)


def test_the_mix_ends_at_the_word(spark):
    """One-document sources: each gets its target to half a word, with white space as in the text."""
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    given = [(1, "\t " + text(1000), "a"), (2, text(2000).replace(" w7 ", "\n\n w7  "), "b"), (3, text(100), "c"), (4, text(950), None), (5, None, "b"), (6, " ", "a")]
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in given], "doc_id long, text string, source string, n_chars int")
    goals = {r.key: round(r.target) for r in M.targets(M.sized(docs)).collect()}
    rows = M.repeat_to_targets(docs).collect()
    words = {}
    for r in rows:
        whole = given[r.doc_id - 1][1]
        assert whole == r.text or (whole.startswith(r.text) and whole[len(r.text)].isspace())
        assert r.n_chars == len(r.text)
        key = "n" if r.source is None else "s" + r.source
        words[key] = words.get(key, 0) + len(r.text.split())
    assert words == {k: v for k, v in goals.items() if v}
    assert abs(sum(words.values()) - 4050) <= 2  # half a word a source

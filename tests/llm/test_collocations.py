import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import collocations as C


def spelled(rows, least, most=2000):
    one, two, three = Counter(), Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            for size, counter in ((1, one), (2, two), (3, three)):
                counter.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    n = Counter()
    for (lang, _), f in one.items():
        n[lang] += f
    every = {**one, **two, **three}
    longest = Counter()
    for (lang, *words), f in three.items():
        if f >= least:
            for part in (words[:2], words[1:]):
                longest[(lang, *part)] = max(longest[(lang, *part)], f)
    found = defaultdict(list)
    for (lang, *words), a in {**two, **three}.items():
        if a < least or (len(words) == 2 and longest[(lang, *words)] >= least and 100 * longest[(lang, *words)] >= 50 * a):
            continue
        cuts = [(1_000_000 * a * a // (every[(lang, *words[:k])] * every[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), every[(lang, *words[:k])], every[(lang, *words[k:])]))
    out = []
    for lang, phrases in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(spark, rows, **options):
    frame = spark.createDataFrame([(t, lang, 1, "x", 2) for lang, t in rows], "text string, lang string, doc_id long, phrase string, a int").repartition(6)
    return sorted(tuple(r) for r in C.collocations(frame, **options).collect())


def sample(count, seed=3):
    rng = random.Random(seed)
    words = [*"abcdefgh", "The", "ÉTÉ", "été", "x\x00y", "don't", "#"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice(["", *[" "] * 6, "\t", "  ", ". ", ",", "\n", "; ", "\r\n", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), ("de", " \t\n.,"), ("en", "hot pair again " * 300)]


@pytest.mark.parametrize("held", [50, 2_000_000])
def test_equal_to_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(C, "WORDS_HELD", held)  # small: many blocks of the same stripes
    rows = sample(400)
    assert got(spark, rows, least=10) == spelled(rows, 10)
    assert got(spark, rows, least=3, most=20) == spelled(rows, 3, 20)


def test_subsumption_from_both_sides_and_at_half(spark):
    rows = [("en", "left mid right. " * 10 + "mid right. " * 10 + "left mid. " * 11), ("en", "p q r. " * 9 + "p q. " * 2)]
    found = got(spark, rows)
    assert [r[2] for r in found] == [r[2] for r in spelled(rows, 10)]
    assert {"left mid right", "left mid", "p q"} <= {r[2] for r in found} and "mid right" not in {r[2] for r in found}


def test_one_prefix_with_many_words_is_spread(spark):
    """A pair that precedes every other word: its stripe lies in many parts."""
    rows = [("en", " ".join(f"of the w{i % 900}." for i in range(k, k + 300))) for k in range(0, 4500, 100)]
    frame = spark.createDataFrame([(lang, t) for lang, t in rows], "lang string, text string")
    blocks = C.stripes(frame, 16).groupBy("part").agg(F.count("part").alias("n")).count()
    assert blocks > 8
    assert got(spark, rows) == spelled(rows, 10)


def test_scores_beyond_64_bits(spark):
    frame = spark.createDataFrame([(10**12, 10**12, 10**12), (3 * 10**14, 4 * 10**14, 5 * 10**17), (10, 10**18, 10**18)], "a long, l long, r long")
    assert [r[0] for r in frame.select(C._score(F.col("a"), F.col("l"), F.col("r"))).collect()] == [1_000_000, 1_000_000 * 9 * 10**28 // (20 * 10**31), 0]


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), ("en", "...")]) == []

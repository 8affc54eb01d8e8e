"""Phrase collocations by stripes: every prefix keys an associative counter of the words that follow it.

An occurrence of a word adds one to one stripe: that of the two-word prefix that begins there, at the word that follows
(or at an end mark, where the piece ends sooner).  Everything else is read off the merged stripes:

* an element of a two-word prefix's stripe is the count of a three-word phrase, the stripe's total that of the two words,
  and its largest element says whether a longer phrase subsumes them;
* these totals are in turn the elements of the stripe of the first word alone, whose total is the count of that word.

Tasks keep word numbers in flat arrays and merge equal (prefix, next word) by sorting.  Stripes travel packed: a block has
its own list of words, three arrays of places in it and one of counts.  A stripe is dealt in segments by its next word, so
that a prefix which holds a third of all words is spread over all tasks; segments are merged elementwise, and their totals
meet in the next level.  The number of parts follows from the bytes of text, so that a task's memory does not grow with them.

Edge cases: a null text is empty and a null language is ``und``, together with rows that say so; a text of separators has
no words; repeated rows count again; a text of any length is cut only at its pieces; an empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column, prepare, read_table, stored

LEAST_COUNT = 10
#: A phrase is dropped if a longer candidate that holds it has at least this share of its occurrences, in percent.
SUBSUMED = 50
MOST_PHRASES = 2000
#: Words a task counts before it packs its stripes, bytes of text that make one part.
WORDS_HELD = 2_000_000
PART_BYTES = 16 << 20
_SALTS = 64
_END = b"\n"
#: Pieces end at these characters; a tab separates words like a space.
_TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")
_STRIPE = "kind string, part int, lang string, words binary, grams binary, first binary, second binary, third binary, a bigint, longest bigint"
_FIELDS = [x.split()[0] for x in _STRIPE.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


class _Numbers(dict):
    """Gives every new word the next number; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(text: bytes, numbers: _Numbers) -> np.ndarray:
    """Word numbers of a text in order, with a 0 after every piece."""
    tokens = text.lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
    tokens.append(_END)
    tokens = list(filter(None, tokens))
    return np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))


def merged(grams: np.ndarray, counts: np.ndarray, largest: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Equal columns of ``grams`` (3 rows) become one, in order, with the sum of ``counts`` and the maximum of ``largest``."""
    if not grams.shape[1]:
        return grams, counts, largest
    base = int(grams.max()) + 1
    key = grams[0] * base + grams[1]
    if base**3 >= 1 << 63:
        key = np.unique(key, return_inverse=True)[1]
    key = key * base + grams[2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    most = None if largest is None else np.maximum.reduceat(largest[order], starts)
    return grams[:, order[starts]], np.add.reduceat(counts[order], starts), most


def _parts(lang: str, words: np.ndarray, grams: np.ndarray, parts: int) -> np.ndarray:
    """Part of every (first, second, next): the next word says which segment of the prefix's stripe it is in."""
    first, second, following = (words[g] for g in grams)
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + following % np.uint64(parts) + np.uint64(xxh64_intdigest(lang))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _packed(kind: str, lang: str, words: list[bytes], grams: np.ndarray, counts: np.ndarray, largest: np.ndarray, parts: int) -> Iterator[dict]:
    """One block of stripes for every part that gets some."""
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    part = _parts(lang, hashes, grams, parts)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
    for low, high in zip(edges[:-1], edges[1:]):
        at = order[low:high]
        used, local = np.unique(grams[:, at], return_inverse=True)
        body = np.concatenate([local.reshape(3, -1).astype("<u4").view("u1").ravel(), counts[at].astype("<i8").view("u1"), largest[at].astype("<i8").view("u1")])
        listed = b"\n".join(words[i] for i in used.tolist() if i)
        yield {
            "kind": kind, "part": int(part[at[0]]), "lang": lang, "words": listed,
            "grams": len(at).to_bytes(8, "little") + pa.compress(body.tobytes(), codec="zstd", asbytes=True),
        }


def _unpacked(grams: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = int.from_bytes(grams[:8], "little")
    body = np.frombuffer(pa.decompress(grams[8:], count * 28, codec="zstd", asbytes=True), "u1")
    return body[: 12 * count].view("<u4").reshape(3, -1).astype(np.int64), body[12 * count : 20 * count].view("<i8"), body[20 * count :].view("<i8")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(_FIELDS, _TYPES)], _FIELDS)


def stripes(docs: DataFrame, parts: int) -> DataFrame:
    """Blocks of stripes of two-word prefixes, merged inside a task as far as its memory goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        numbers, count = _Numbers(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for lang, arrays in held.items():
                flat = np.concatenate([*arrays, [0, 0]])
                second = flat[1:-1]
                grams = np.stack([flat[:-2], second, np.where(second == 0, 0, flat[2:])])[:, flat[:-2] != 0]
                grams, counts, _ = merged(grams, np.ones(grams.shape[1], np.int64))
                for row in _packed("stripe", lang, words, grams, counts, np.zeros_like(counts), parts):
                    yield _batch([row])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist()):
                found = numbered(text, numbers)
                held.setdefault(lang, []).append(found)
                count += len(found)
                if count >= WORDS_HELD:
                    yield from flush()
                    held, numbers, count = {}, _Numbers(), 0
        yield from flush()

    lang = F.coalesce(column(docs, "lang", "string"), F.lit("und"))
    body = F.coalesce(column(docs, "text", "binary"), F.lit(b""))
    return docs.select(lang.alias("lang"), body.alias("body")).mapInArrow(run, _STRIPE)


def _merge_part(blocks: Iterator[tuple[str, bytes, bytes]]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, words, grams, counts, largest) per language of a part."""
    numbers, held, pending = {}, {}, {}

    def compact(lang: str) -> None:
        grams, counts, largest = zip(*held[lang])
        held[lang] = [merged(np.concatenate(grams, axis=1), np.concatenate(counts), np.concatenate(largest))]
        pending[lang] = 0

    for lang, listed, packed in blocks:
        known = numbers.setdefault(lang, _Numbers())
        grams, counts, largest = _unpacked(packed)
        # Place 0 of a block is the end mark only if its stripes use it; its list has no entry for it.
        words = listed.split(b"\n") if listed else []
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if int(grams.max()) == len(words):
            places = np.concatenate(([0], places))
        held.setdefault(lang, []).append((places[grams], counts, largest))
        pending[lang] = pending.get(lang, 0) + len(counts)
        if pending[lang] > 2 * len(held[lang][0][1]) + WORDS_HELD:
            compact(lang)
    for lang in held:
        compact(lang)
        yield (lang, list(numbers[lang]), *held[lang][0])


def _dealt(blocks: DataFrame, parts: int, run) -> DataFrame:
    source = blocks.select("part", "lang", "words", "grams").repartitionById(parts, F.col("part")).select("lang", "words", "grams")
    return source.mapInArrow(run, _STRIPE)


def _phrases(kind: str, lang: str, words: list[bytes], grams: np.ndarray, counts: np.ndarray, largest: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows of single phrases, a few thousand a batch."""
    listed = np.array([*words, None], object)
    for low in range(0, len(counts), 5000):
        cut = slice(low, low + 5000)
        size = len(counts[cut])
        columns = [listed[grams[k, cut]] if k < wide else [None] * size for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * size), pa.nulls(size, pa.int32()), pa.array([lang] * size), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()), *(pa.array(list(c), pa.binary()) for c in columns), pa.array(counts[cut]), pa.array(largest[cut])], _FIELDS)


def merge_pairs(blocks: DataFrame, parts: int, least: int) -> DataFrame:
    """Merged stripes of two-word prefixes: frequent three-word phrases, and the totals as stripes of the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "grams"))))
        for lang, words, grams, counts, _ in _merge_part(rows):
            whole = (grams[2] != 0) & (counts >= least)
            yield from _phrases("three", lang, words, grams[:, whole], counts[whole], counts[whole], 3)
            starts = np.flatnonzero((np.diff(grams[0], prepend=-1) != 0) | (np.diff(grams[1], prepend=-1) != 0))
            longest = np.maximum.reduceat(np.where(grams[2] != 0, counts, 0), starts)
            # The prefix becomes (first word, no second), the second word its next one.
            heads = np.stack([grams[0, starts], np.zeros(len(starts), np.int64), grams[1, starts]])
            for row in _packed("total", lang, words, heads, np.add.reduceat(counts, starts), longest, parts):
                yield _batch([row])

    return _dealt(blocks, parts, run)


def merge_words(blocks: DataFrame, parts: int, least: int) -> DataFrame:
    """Merged stripes of single words: frequent two-word phrases with their largest extension, and the words' own totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "grams"))))
        for lang, words, grams, counts, longest in _merge_part(rows):
            whole = (grams[2] != 0) & (counts >= least)
            yield from _phrases("two", lang, words, grams[::2][:, whole], counts[whole], longest[whole], 2)
            starts = np.flatnonzero(np.diff(grams[0], prepend=-1))
            totals = np.add.reduceat(counts, starts)
            yield from _phrases("one", lang, words, grams[:1, starts], totals, totals, 1)

    return _dealt(blocks, parts, run)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact: the products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    numerator = F.lit(1_000_000).cast("decimal(7,0)") * a.cast("decimal(15,0)") * a.cast("decimal(15,0)")
    return F.call_function("div", numerator, wide(left) * wide(right))


def counts(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples): every word (lang, first, f), and the phrases found ``least`` times or more."""
    spark = prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(column(docs, "text", "string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    three = stored(merge_pairs(stripes(docs, parts), parts, least), "phrases-three")
    two = stored(merge_words(three.filter("kind = 'total'"), parts, least), "phrases-two")
    text = lambda name: F.col(name).cast("string").alias(name)
    words = stored(two.filter("kind = 'one'").groupBy("lang", text("first")).agg(F.sum("a").alias("f")), "phrases-one")
    pairs = two.filter("kind = 'two'").select("lang", text("first"), text("second"), "a", "longest")
    triples = three.filter("kind = 'three'").select("lang", text("first"), text("second"), text("third"), "a")
    return words, pairs, triples


def collocations(docs: DataFrame, least: int = LEAST_COUNT, most: int = MOST_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases."""
    words, pairs, triples = counts(docs, least)
    known = words.filter(F.col("f") >= least)
    # A pair's words are at least as frequent as the pair, so all of them are among the known ones.
    pairs = pairs.join(known.select("lang", "first", F.col("f").alias("f_first")), ["lang", "first"])
    pairs = stored(pairs.join(known.select("lang", F.col("first").alias("second"), F.col("f").alias("f_second")), ["lang", "second"]), "phrases-pairs")
    ahead = pairs.select("lang", "first", "second", F.col("a").alias("a_front"), F.col("f_first").alias("f_head"))
    behind = pairs.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("a_back"), F.col("f_second").alias("f_tail"))
    triples = stored(triples.join(ahead, ["lang", "first", "second"]).join(behind, ["lang", "second", "third"]), "phrases-triples")

    early, late = _score(F.col("a"), F.col("f_head"), F.col("a_back")), _score(F.col("a"), F.col("a_front"), F.col("f_tail"))
    cut = lambda x, y: F.when(F.col("early") <= F.col("late"), F.col(x)).otherwise(F.col(y))
    phrase = lambda *names: F.concat_ws(" ", *names).alias("phrase")
    long = triples.withColumn("early", early).withColumn("late", late).select(
        "lang", phrase("first", "second", "third"), "a", cut("f_head", "a_front").alias("l"), cut("a_back", "f_tail").alias("r"), F.least("early", "late").alias("score"))

    after = triples.groupBy("lang", F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("after"))
    longest = F.greatest(F.when(F.col("longest") >= least, F.col("longest")).otherwise(F.lit(0)), F.coalesce("after", F.lit(0)))
    short = pairs.join(after, ["lang", "first", "second"], "left").filter(100 * longest < SUBSUMED * F.col("a")).select(
        "lang", phrase("first", "second"), "a", F.col("f_first").alias("l"), F.col("f_second").alias("r"), _score(F.col("a"), F.col("f_first"), F.col("f_second")).alias("score"))

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = short.unionByName(long).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    # First the best of every slice of a language, then the best of these.
    for by in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= most)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return salted.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
x AS (SELECT lang, ws[i] AS a1, ws[i + 1] AS a2, ws[i + 2] AS a3 FROM g),
f1 AS (SELECT lang, a1, count(*) AS f FROM x GROUP BY ALL),
f2 AS (SELECT lang, a1, a2, count(*) AS f FROM x WHERE a2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a1, a2, a3, count(*) AS f FROM x WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
m AS (SELECT lang, a1, a2, max(f) AS m FROM (SELECT lang, a1, a2, f FROM f3 UNION ALL SELECT lang, a2, a3, f FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, f2.a1 || ' ' || f2.a2 AS phrase, f2.f AS a, u.f AS l, v.f AS r, 1000000::HUGEINT * f2.f * f2.f // (u.f::HUGEINT * v.f) AS score
  FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.a1 = f2.a1 JOIN f1 v ON v.lang = f2.lang AND v.a1 = f2.a2
  LEFT JOIN m ON m.lang = f2.lang AND m.a1 = f2.a1 AND m.a2 = f2.a2 WHERE 100 * coalesce(m.m, 0) < 50 * f2.f),
cuts AS (SELECT f3.lang, f3.a1 || ' ' || f3.a2 || ' ' || f3.a3 AS phrase, f3.f AS a, u.f AS l1, vw.f AS r1, uv.f AS l2, w1.f AS r2,
  1000000::HUGEINT * f3.f * f3.f // (u.f::HUGEINT * vw.f) AS s1, 1000000::HUGEINT * f3.f * f3.f // (uv.f::HUGEINT * w1.f) AS s2
  FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.a1 = f3.a1 JOIN f2 vw ON vw.lang = f3.lang AND vw.a1 = f3.a2 AND vw.a2 = f3.a3
  JOIN f2 uv ON uv.lang = f3.lang AND uv.a1 = f3.a1 AND uv.a2 = f3.a2 JOIN f1 w1 ON w1.lang = f3.lang AND w1.a1 = f3.a3),
found AS (SELECT * FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts)
SELECT found.lang, row_number() OVER (PARTITION BY found.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score::BIGINT AS score
FROM found JOIN n ON n.lang = found.lang QUALIFY rank <= 2000"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": _SQL}

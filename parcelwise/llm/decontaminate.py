"""Benchmark decontamination by latent semantic retrieval.

1. Words are lower-cased and stripped of marks; the vocabulary is that of the benchmark.
   Document frequencies are counted over all documents.
   Words in over ``COMMON_SHARE`` of them weigh nothing, unless an item would keep fewer than four others.
2. Documents are cut into passages of 48 words, 16 apart.  A randomised SVD of the TF-IDF passages gives the latent
   space: a random basis is sharpened by passes over the distributed passages (each task adds up its part of
   ``A'AQ``, Spark sums the parts per word) and made orthonormal on the driver, whose matrix is vocabulary by rank.
   The fit takes the benchmark's own passages and those of every document.  Documents are turned into word numbers once
   per block; the counts, the passes and the search all read those.
3. Every passage of every document is projected and compared with every benchmark passage: the cosine of the passage
   and the item's projection, as a share of the item's own.  A passage counts as no longer than the item, and words outside the
   vocabulary not at all, so what surrounds a short item, and the size of the corpus, do not hide it.
   Items of whose words too few are anywhere in the document cannot count and are left out before; so are documents for
   which no item is left.
4. A candidate counts if the longest common subsequence of the item and the surroundings covers ``least_lcs`` of the
   item's words and that of its answer (the last sentence) ``least_answer`` of the answer's: a reworded copy still passes, words
   in common do not.

The benchmark is worked on in blocks of ``BLOCK_ITEMS`` items, so neither the driver nor a task ever holds more.

Edge cases: null or blank texts match nothing; items without a word are left out; repeated rows are each reported;
items with equal texts are each reported; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare, read_table, remove, slices, stored

STEP, STEPS = 16, 3
RANK = 128
COMMON_SHARE, LEAST_COMMON = 0.05, 50
LEAST_COSINE = 0.3
LEAST_LCS = 0.7
LEAST_ANSWER = 0.6
BLOCK_ITEMS = 2000
POWER_ROUNDS = 2
#: Words of the texts whose passages are added up at a time.
GRAM_WORDS = 25_000
#: Bytes of partial rows that one group of words adds up.
PART_BYTES = 16 << 20
#: Numbers in a stream of words: outside the vocabulary, and none (behind a text).
UNKNOWN, PADDING = -1, -2
SEED = 11


_MARKS = bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\n\r\x0b\x0c")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII marks; words that are nothing but marks are left out."""
    return (text or "").lower().encode().translate(None, _MARKS).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence that has any."""
    return next((w for w in map(words_of, reversed(re.split(r"[.!?]\s|\n", text))) if w), [])


def numbered(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words in the vocabulary, ``UNKNOWN`` for others."""
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, repeat(UNKNOWN)), np.int32, len(words))


def encoded(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, body_hash, words): each row's text as 32-bit word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([numbered(t, vocabulary).tobytes() for t in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body_hash"), words], ["doc_id", "body_hash", "words"])

    return docs.select("doc_id", "body_hash", "body").mapInArrow(run, "doc_id bigint, body_hash bigint, words binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("words" if "words" in docs.columns else "body")


def _numbers(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    """Word numbers of a batch, from its column ``words`` if it is encoded, else from its texts."""
    if "words" in batch.schema.names:
        return [np.frombuffer(w, np.int32) for w in batch.column("words").to_pylist()]
    return [numbered(t, vocabulary) for t in batch.column("body").to_pylist()]


def common_subsequence(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, 64 words of the item and more at a time in the bits of a number.

    ``masks`` has, for each word, the places of the item at which it stands.
    """
    full = (1 << size) - 1
    state = full
    for word in other:
        hit = masks.get(word)
        if hit:
            same = state & hit
            state = ((state + same) | (state - same)) & full
    return size - state.bit_count()


def _masks(numbers: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for place, n in enumerate(numbers):
        out[n] = out.get(n, 0) | 1 << place
    return out


def grid(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words of all texts, each filled up to whole steps; first step of each passage)."""
    filled, firsts, at = [], [], 0
    for x in numbers:
        steps = max(STEPS, -(-len(x) // STEP))
        row = np.full(steps * STEP, PADDING, np.int32)
        row[: len(x)] = x
        filled.append(row)
        firsts.append(np.arange(at, at + steps - STEPS + 1))
        at += steps
    return (np.concatenate(filled), np.concatenate(firsts)) if filled else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def passages(numbers: list[np.ndarray], vectors: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of word vectors, sum of squared weights, first step) of each passage that holds a weighted word.

    The last of ``squares`` is that of words outside the vocabulary: nothing.
    """
    stream, firsts = grid(numbers)
    steps = len(stream) // STEP
    inside = np.flatnonzero(stream >= 0)
    inside = inside[squares[stream[inside]] > 0]
    held = np.bincount(inside // STEP, minlength=steps) > 0
    firsts = firsts[sum(held[firsts + k].astype(int) for k in range(STEPS)) > 0]
    if not len(firsts):
        return np.zeros((0, vectors.shape[1]), vectors.dtype), np.zeros(0), firsts
    row_of = np.cumsum(held) * held  # steps without a weighted word share row 0
    sums = np.zeros((int(held.sum()) + 1, vectors.shape[1]), vectors.dtype)
    cuts = np.flatnonzero(np.append(True, np.diff(inside // STEP) > 0))
    sums[1:] = np.add.reduceat(vectors[stream[inside]], cuts, axis=0)
    lengths = squares[stream].reshape(steps, STEP).sum(1)
    return sum(sums[row_of[firsts + k]] for k in range(STEPS)), sum(lengths[firsts + k] for k in range(STEPS)), firsts


class Index:
    """What a task needs to search: the vocabulary, word vectors and the items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words_of(t), answer_of(t)) for i, t in items]
        self.items = [x for x in self.items if x[1]]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, words, _ in self.items for w in words}))}
        self.numbers = [[self.vocabulary[w] for w in words] for _, words, _ in self.items]
        self.idf = np.ones(len(self.vocabulary))
        self.basis: np.ndarray | None = None

    def item_passages(self) -> tuple[list[np.ndarray], list[int]]:
        """Pieces of the items of at most a passage's length, and the item each belongs to."""
        size = STEP * STEPS
        pieces, owners = [], []
        for n, words in enumerate(self.numbers):
            starts = sorted({*range(0, max(1, len(words) - size + 1), size // 2), max(0, len(words) - size)})
            pieces += [np.array(words[s : s + size], np.int32) for s in starts]
            owners += [n] * len(starts)
        return pieces, owners

    def weight_frequencies(self, docs: DataFrame) -> None:
        """Document frequencies over all documents; one number per word of the block comes back."""
        vocabulary = self.vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, total = np.zeros(len(vocabulary) + 1, np.int64), 0
            for batch in batches:
                for found in _numbers(batch, vocabulary):
                    seen[np.unique(found[found >= 0])] += 1
                    total += 1
            seen[-1] = total
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["word", "n"])

        counted = _texts(docs).mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(vocabulary) + 1)
        df[counted["word"]] = counted["n"]
        self.idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
        common = df[:-1] > max(COMMON_SHARE * df[-1], LEAST_COMMON)
        for words in self.numbers:
            if np.count_nonzero(~common[words]) < 4:
                common[words] = False
        self.idf[common] = 0.0

    def squares(self) -> np.ndarray:
        """Squared weights by number; behind them those of no word and of a word outside the vocabulary, both nothing."""
        return np.concatenate([self.idf**2, [0.0, 0.0]])

    def fit(self, docs: DataFrame, rank: int = RANK) -> None:
        """Randomised SVD: right singular vectors of the TF-IDF passages of the documents and the items."""
        size = len(self.vocabulary)
        rank = min(rank, size)
        own = self.item_passages()[0]
        basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, rank)))[0]
        for _ in range(POWER_ROUNDS):
            basis = np.linalg.qr(self._sharpened(docs, own, basis))[0]
        small = basis.T @ self._sharpened(docs, own, basis)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        self.basis = basis @ turn[:, np.argsort(-values)]

    def _sharpened(self, docs: DataFrame, own: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
        vocabulary, idf = self.vocabulary, self.idf
        texts = _texts(docs)
        parts = 1 + basis.nbytes * texts.rdd.getNumPartitions() // PART_BYTES

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(basis)
            vectors = (idf[:, None] * basis).astype(np.float32)
            for batch in batches:
                numbers = _numbers(batch, vocabulary)
                for some in slices(numbers, [len(x) for x in numbers], GRAM_WORDS):
                    add_gram_times(some, idf, vectors, total)
            some = np.flatnonzero(np.abs(total).sum(1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array((some % parts).astype(np.int32)), pa.array(some.astype(np.int32)), pa.array([total[n].tobytes() for n in some], pa.binary())], ["part", "word", "row"])

        def add(group: pd.DataFrame) -> pd.DataFrame:
            words, at = np.unique(group["word"], return_inverse=True)
            total = np.zeros((len(words), basis.shape[1]))
            np.add.at(total, at, np.stack([np.frombuffer(r) for r in group["row"]]))
            return pd.DataFrame({"word": words.astype(np.int32), "row": [r.tobytes() for r in total]})

        summed = texts.mapInArrow(part, "part int, word int, row binary").groupBy("part").applyInPandas(add, "word int, row binary").toPandas()
        out = gram_times(own, idf, basis)
        for word, row in zip(summed["word"], summed["row"]):
            out[word] += np.frombuffer(row)
        return out


def gram_times(numbers: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A'(A basis)`` for the TF-IDF passages of some texts."""
    out, vectors = np.zeros_like(basis), (idf[:, None] * basis).astype(np.float32)
    for some in slices(numbers, [len(x) for x in numbers], GRAM_WORDS):
        add_gram_times(some, idf, vectors, out)
    return out


def add_gram_times(numbers: list[np.ndarray], idf: np.ndarray, vectors: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` that of some texts, a few at a time so that their rows stay in the processor's cache; ``vectors`` are the weighted rows of the basis."""
    stream, firsts = grid(numbers)
    inside = np.flatnonzero(stream >= 0)
    inside = inside[idf[stream[inside]] > 0]
    if not len(inside):
        return
    words, steps = stream[inside], inside // STEP
    cuts = np.flatnonzero(np.append(True, np.diff(steps) > 0))
    row_of = np.zeros(len(stream) // STEP, np.int64)  # steps without a weighted word share row 0
    row_of[steps[cuts]] = np.arange(1, len(cuts) + 1)
    sums = np.zeros((len(cuts) + 1, vectors.shape[1]), np.float32)
    place = np.arange(len(words)) - np.repeat(cuts, np.diff(np.append(cuts, len(words))))
    for k in range(int(place.max()) + 1):  # the k-th weighted word of every step that has one
        at = np.flatnonzero(place == k)
        sums[row_of[steps[at]]] += vectors[words[at]]
    rows = np.stack([row_of[firsts + k] for k in range(STEPS)])
    rows = rows[:, rows.any(0)]
    whole = sum(sums[r] for r in rows)
    back = np.zeros_like(sums)
    for r in rows:  # a step is the k-th of one passage only, so no row but 0 comes twice
        back[r] += whole
    order = np.argsort(words, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(words[order]) > 0))
    some = words[order[starts]]
    out[some] += idf[some, None] * np.add.reduceat(back[row_of[steps[order]]], starts, axis=0)


_HITS = "doc_id bigint, body_hash bigint, item_id bigint, cosine double, lcs_share double, answer_share double"


def search(docs: DataFrame, index: Index, least_cosine: float = LEAST_COSINE, least_lcs: float = LEAST_LCS, least_answer: float = LEAST_ANSWER) -> DataFrame:
    """(doc_id, body_hash, item_id, cosine, lcs_share, answer_share) of every confirmed (row, item)."""
    vectors = (index.idf[:, None] * index.basis).astype(np.float32)
    pieces, owners = index.item_passages()
    squares = index.squares()
    # An item's passage as a direction, over the share of its length that lies in the space: it scores 1 with itself.
    targets = np.array([vectors[p].sum(0) for p in pieces])
    whole = np.sqrt([sum((n * index.idf[w]) ** 2 for w, n in zip(*np.unique(p, return_counts=True))) for p in pieces])
    targets *= (whole / np.maximum((targets**2).sum(1), 1e-12))[:, None]
    owner = np.array(owners)
    square_whole = (whole**2).astype(np.float32)
    vocabulary, ids, numbers = index.vocabulary, [x[0] for x in index.items], index.numbers
    answers = [[index.vocabulary[w] for w in x[2]] for x in index.items]

    def shares(lists: list[list[int]]) -> Callable[[np.ndarray], np.ndarray]:
        flat, sizes = np.concatenate([np.array(x, np.int32) for x in lists]), np.array([len(x) for x in lists])
        starts = np.cumsum(sizes) - sizes
        return lambda present: np.add.reduceat(present[flat], starts) / sizes

    item_share, answer_share = shares(numbers), shares(answers)

    def possible(words: np.ndarray) -> np.ndarray:
        """Items of whose words, and whose answer's, enough are somewhere in the text for a common subsequence."""
        present = np.zeros(len(vocabulary), np.int64)
        present[words[words >= 0]] = 1
        return (item_share(present) >= least_lcs - 1e-9) & (answer_share(present) >= least_answer - 1e-9)

    def confirm(words: np.ndarray, item: int, places: list[int], cosine: list[float]) -> tuple[float, float, float] | None:
        size, answer = len(numbers[item]), answers[item]
        masks, answer_masks = _masks(numbers[item]), _masks(answer)
        wanted = np.zeros(len(vocabulary) + 1, bool)  # the last is that of words outside the vocabulary
        wanted[numbers[item]] = wanted[answer] = True
        where = np.flatnonzero(wanted[words])  # no other word can be in a common subsequence
        at = 0
        best = None
        while at < len(places):
            end = at + 1
            while end < len(places) and places[end] - places[end - 1] <= size:
                end += 1
            first, last = np.searchsorted(where, (places[at] - size, places[end - 1] + STEP * STEPS + size))
            near = words[where[first:last]].tolist()
            share = len(near) / size
            if share >= least_lcs:
                share = common_subsequence(masks, size, near) / size
            if share >= least_lcs:
                got = common_subsequence(answer_masks, len(answer), near) / len(answer)
                if got >= least_answer and (best is None or share > best[1]):
                    best = (max(cosine[at:end]), share, got)
            at = end
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _numbers(batch, vocabulary)
            able = np.array([possible(x) for x in found]).reshape(len(found), len(ids))
            some_able = np.flatnonzero(able.any(1))
            batch, able, found = batch.take(pa.array(some_able)), able[some_able], [found[n] for n in some_able]
            sums, lengths, firsts = passages(found, vectors, squares)
            bounds = np.concatenate([[0], np.cumsum([max(STEPS, -(-len(x) // STEP)) for x in found])])
            doc_of = np.searchsorted(bounds, firsts, "right") - 1
            hits = []
            for low in range(0, len(firsts), 8192):
                some = sums[low : low + 8192]
                length = np.minimum(lengths[low : low + 8192].astype(np.float32)[:, None], square_whole)
                cosine = (some @ targets.T) / np.sqrt(np.maximum(length, 1e-12))
                at, of = np.nonzero(cosine >= least_cosine)
                likely = able[doc_of[low + at], owner[of]]
                at, of = at[likely], of[likely]
                doc = doc_of[low + at]
                hits.append((doc, owner[of], (firsts[low + at] - bounds[doc]) * STEP, np.minimum(1.0, cosine[at, of].astype(float))))
            if not hits:
                continue
            doc, item, place, near = (np.concatenate(c) for c in zip(*hits))
            order = np.lexsort((near, place, item, doc))
            doc, item, place, near = doc[order], item[order], place[order], near[order]
            cuts = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)).tolist()
            rows = []
            doc_ids, hashes = batch.column("doc_id").to_pylist(), batch.column("body_hash").to_pylist()
            for low, high in zip(cuts, [*cuts[1:], len(doc)]):
                d, i = int(doc[low]), int(item[low])
                got = confirm(found[d], i, place[low:high].tolist(), near[low:high].tolist())
                if got:
                    rows.append((doc_ids[d], hashes[d], ids[i], *got))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _HITS.split(", ")])

    return docs.mapInArrow(run, _HITS)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(column(benchmark, "item_id", "bigint").alias("item_id"), column(benchmark, "text", "string").alias("text")).filter("text is not null").orderBy("item_id", "text")
    block: list[tuple[int, str]] = []
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, **limits: float) -> DataFrame:
    """Every confirmed (row of ``docs``, item)."""
    spark = prepare(docs.sparkSession)
    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.xxhash64(column(docs, "text", "string")).alias("body_hash"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("body"))
    out = spark.createDataFrame([], _HITS)
    for items in _blocks(benchmark, block_items):
        index = Index(items)
        if not index.items:
            continue
        texts = stored(encoded(source, index.vocabulary), "latent-words")
        index.weight_frequencies(texts)
        index.fit(texts)
        out = out.unionByName(stored(search(texts, index, **limits), "latent-hits"))
        remove(texts)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, in its columns."""
    found = stored(contaminated(docs, benchmark), "contaminated").select(F.col("doc_id").alias("_id"), F.col("body_hash").alias("_hash")).distinct()
    rows = docs.withColumns({"_key": column(docs, "doc_id", "bigint"), "_body": F.xxhash64(column(docs, "text", "string"))})
    return rows.join(found, rows["_key"].eqNullSafe(found["_id"]) & (rows["_body"] == found["_hash"]), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "cosine", "lcs_share", "answer_share")


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}

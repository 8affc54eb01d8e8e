import random

import numpy as np
import pyarrow as pa

from parcelwise.llm import decontaminate as D

rng = random.Random(9)
COMMON = "the of and to in is was for on that".split()
WORD = lambda: rng.choice(COMMON) if rng.random() < 0.35 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
TEXT = lambda n: " ".join(WORD() for _ in range(n))
ITEMS = [(n, f"{TEXT(rng.randint(14, 70))}. {TEXT(6)}.") for n in range(25)]


def reworded(text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), int(len(words) * share)):
        words[i] = "changed" + str(i)
    return " ".join(words)


def world():
    docs, want = [], set()
    for n in range(150):
        text = TEXT(rng.randint(0, 400))
        if n % 3 == 0:
            item, passage = ITEMS[n % 25]
            passage = [passage, reworded(passage, 0.12), passage.upper().replace(" ", "!! "), passage.replace(" ", "\n")][n % 4]
            at = rng.choice([0, len(text)])
            text = f"{text[:at]} {passage} {text[at:]}"
            want.add((n, item))
        docs.append((n, text, "x"))
    return docs, want


def brute(docs):
    """Every item against every surrounding of every document, without the latent space."""
    out = set()
    for doc, text, *_ in docs:
        words = D.words_of(text)
        for item, body in ITEMS:
            own, answer = D.words_of(body), D.answer_of(body)
            for low in range(0, max(1, len(words)), D.STEP):
                near = words[max(0, low - len(own)) : low + D.STEP * D.STEPS + len(own)]
                if subsequence(own, near) >= D.LEAST_LCS * len(own) and subsequence(answer, near) >= D.LEAST_ANSWER * len(answer):
                    out.add((doc, item))
                    break
    return out


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def found(spark, docs, items=ITEMS, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, body int")
    return sorted(((r.doc_id, r.item_id) for r in D.contaminated(frame, bench, **options).collect()), key=str)


def test_planted_and_brute_force(spark):
    docs, want = world()
    got = set(found(spark, docs))
    assert want <= got
    everything = brute(docs)
    assert got <= everything and len(got) >= 0.9 * len(everything)


def test_blocks_give_the_same(spark):
    docs, want = world()
    assert want <= set(found(spark, docs[:40], block_items=7)) | {w for w in want if w[0] >= 40}


def test_odd_rows(spark):
    item = ITEMS[0][1]
    docs = [(None, item, "x"), (1, None, "x"), (2, "", "x"), (3, item, "x"), (3, item, "x"), (4, "the the the " * 500, "x"), (5, TEXT(20000) + " " + item, "x")]
    items = [*ITEMS, (50, None), (51, ""), (52, "..."), (0, item)]
    got = found(spark, docs, items)
    assert got == sorted([(None, 0)] * 2 + [(3, 0)] * 4 + [(5, 0)] * 2, key=str)
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    kept = D.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, "a b", "x")], []) == []


def test_common_subsequence():
    for _ in range(100):
        a, b = [rng.randint(0, 5) for _ in range(rng.randint(1, 80))], [rng.randint(0, 5) for _ in range(rng.randint(0, 90))]
        assert D.common_subsequence(D._masks(a), len(a), b) == subsequence(a, b)


def test_singular_vectors(spark):
    index = D.Index(ITEMS)
    docs = spark.createDataFrame([(t,) for _, t, _ in world()[0]], "body string")
    index.weight_frequencies(docs)
    index.fit(docs, rank=8)
    numbers = [D.numbered(r.body, index.vocabulary) for r in docs.collect()] + index.item_passages()[0]
    stream, firsts = D.grid(numbers)
    rows = np.zeros((len(firsts), len(index.vocabulary)))
    for i, f in enumerate(firsts):
        mine = stream[f * D.STEP : (f + D.STEPS) * D.STEP]
        np.add.at(rows[i], mine[mine >= 0], 1)
    rows *= index.idf
    values = np.linalg.svd(rows, compute_uv=False)[:8]
    mine = np.linalg.norm(rows @ index.basis, axis=0)
    assert np.allclose(index.basis.T @ index.basis, np.eye(8), atol=1e-8)
    assert (mine[:4] >= 0.9 * values[:4]).all() and (mine**2).sum() >= 0.9 * (values**2).sum()


def test_short_items_of_ordinary_words_in_a_large_corpus(spark):
    own = random.Random(17)
    items = [(n, " ".join(f"word{n}x{k}" for k in range(6 + 2 * n))) for n in range(6)]
    fill = lambda n: " ".join(f"other{own.randint(0, 10**6)}" for _ in range(n))
    docs = [(n, fill(3) + " " + " ".join(own.choice(t.split()) for _, t in items), "x") for n in range(4000)]
    docs += [(10_000 + n, f"{fill(60)} {t} {fill(60)}", "x") for n, t in items]
    docs += [(20_000 + n, f"{fill(50)} {' '.join(w for k, w in enumerate(t.split()) if k != 3)} {fill(50)}", "x") for n, t in items]
    got = set(found(spark, docs, items))
    assert {(10_000 + n, n) for n, _ in items} | {(20_000 + n, n) for n, _ in items} <= got


def test_space_is_fitted_on_every_document(spark, monkeypatch):
    seen, fit = [], D.Index.fit

    def counted(self, docs, *rest):
        seen.append(docs.count())
        fit(self, docs, *rest)

    monkeypatch.setattr(D.Index, "fit", counted)
    docs = [(n, f"{ITEMS[n % 25][1]} {n}", "x") for n in range(9000)]
    found(spark, docs, block_items=20)
    assert seen == [9000, 9000]


def test_encoded_rows_give_the_same_space(spark):
    rows = [(n, n, t) for n, t, _ in world()[0]] + [(None, 7, ""), (3, 3, ITEMS[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, body_hash long, body string")
    plain, coded = D.Index(ITEMS), D.Index(ITEMS)
    texts = D.encoded(docs, coded.vocabulary)
    for index, frame in ((plain, docs), (coded, texts)):
        index.weight_frequencies(frame)
        index.fit(frame, rank=8)
    assert (plain.idf == coded.idf).all() and np.allclose(np.abs(np.diag(plain.basis.T @ coded.basis)), 1, atol=1e-4)
    assert [(r.doc_id, r.body_hash) for r in texts.collect()] == [r[:2] for r in rows]


def test_gram_product():
    own = np.random.default_rng(4)
    numbers = [own.integers(-1, 30, n).astype(np.int32) for n in (0, 3, 47, 48, 49, 300)] + [np.full(500, -1, np.int32), np.append(np.full(200, -1), 7).astype(np.int32)]
    idf, basis = own.random(30) + 1, own.standard_normal((30, 5))
    idf[:6] = 0
    stream, firsts = D.grid(numbers)
    rows = np.zeros((len(firsts), 30))
    for i, f in enumerate(firsts):
        mine = stream[f * D.STEP : (f + D.STEPS) * D.STEP]
        np.add.at(rows[i], mine[mine >= 0], 1)
    rows *= idf
    assert np.allclose(D.gram_times(numbers, idf, basis), rows.T @ (rows @ basis), rtol=1e-4, atol=1e-2)
    assert not D.gram_times([], idf, basis).any()


def test_gram_product_a_few_texts_at_a_time(monkeypatch):
    own = np.random.default_rng(6)
    numbers = [own.integers(-1, 30, n).astype(np.int32) for n in (0, 60, 500, 3, 90)]
    idf, basis = own.random(30) + 1, own.standard_normal((30, 5))
    whole = D.gram_times(numbers, idf, basis)
    most, add = [], D.add_gram_times
    monkeypatch.setattr(D, "GRAM_WORDS", 100)
    monkeypatch.setattr(D, "add_gram_times", lambda some, *rest: (most.append(sum(map(len, some))), add(some, *rest)))
    assert np.allclose(D.gram_times(numbers, idf, basis), whole, rtol=1e-5, atol=1e-3)
    assert most == [60, 500, 93]


def test_passages_only_of_texts_that_can_hold_an_item(spark, monkeypatch):
    docs, _ = world()
    rows = [(n, n, t) for n, t, _ in docs]
    frame = spark.createDataFrame(rows, "doc_id long, body_hash long, body string")
    index = D.Index(ITEMS)
    index.weight_frequencies(frame)
    index.fit(frame, rank=8)
    seen, passages, handed, common = [], D.passages, [], D.common_subsequence

    class Captured:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(D, "passages", lambda found, *rest: (seen.append(len(found)), passages(found, *rest))[1])
    monkeypatch.setattr(D, "common_subsequence", lambda masks, size, other: (handed.extend(other), common(masks, size, other))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["doc_id", "body_hash", "body"])
    nothing = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["none of these"])], ["doc_id", "body_hash", "body"])
    got = [(r["doc_id"], r["item_id"]) for out in D.search(Captured(), index)(iter([batch, nothing])) for r in out.to_pylist()]
    assert sorted(got) == sorted((r.doc_id, r.item_id) for r in D.search(frame, index).collect()) and len(got) >= 40
    assert len({d for d, _ in got}) <= seen[0] < 120 and seen[1] == 0
    assert handed and D.UNKNOWN not in handed

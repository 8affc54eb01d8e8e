import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from parcelwise.llm import personal as P

TEXTS = [
    None, "", "plain text only", "mail joe.b@mail5.example.com, or x@y or a@b.c.", "at 152.143.123.131### and 256.1.1.1 and 1.2.3.4.5", "card 4785380592391139$$$ 4000 0000 0000 0002 4111-1111-1111-1111 12345678901234",
    "é +1 (743) 555-3824 éeux +44 20 7946 0958 +12 345", "twice 4465758382889437 4465758382889437 end", "version 2.0. of 3.", "reach me (212) 555-7788 today", "a\x0bb@c.de\x1cf",
]


# The patterns as they are given, tried at every place.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def field():
    return P.Field().fit(P.template_sentences())


def spelled(text):
    text = text or ""
    out = []
    for kind, pattern in GIVEN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(int(d) if n % 2 == 0 else sum(divmod(2 * int(d), 10)) for n, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], P.BASE.index(s[0])))


def test_base_spans_and_digests(spark):
    docs = spark.createDataFrame([(n, t, 1) for n, t in enumerate(TEXTS)] + [(None, TEXTS[3], 1)], "doc_id long, text string, n_email int")
    for r in P.personal_data(docs).collect():
        want = spelled(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in P.BASE)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_base_spans_of_any_text():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "12", "255", "256", "007", "4111 1111 1111 1111", ".", ".", "@", "a", "b-c", "_", "+", "-", " ", "é", "(", "@x.y"]) for _ in range(rng.randint(0, 25)))
        assert sorted(P.base_spans(text), key=lambda s: (s[1], P.BASE.index(s[0]))) == spelled(text), text


def test_very_long_texts(spark, field):
    """No text stops the job or takes more than its length."""
    million = 1_000_000
    texts = ["at 1.1.1." + "5" * 5000, "at 1.1.1." + "0" * 5000 + "1", "7" * million, "a" * million + " b@c.de", "@" * million, "a@" * (million // 2), "1." * (million // 2), "+1(" * (million // 3), "a@b." * (million // 4), "1.2.3.4 " * (million // 8)]
    started = time.time()
    found = [P.base_spans(t) for t in texts]
    assert time.time() - started < 40
    assert ("ip", 3, 9 + 5001) in found[1] and found[0] == [] and ("email", million + 1, million + 7) in found[3] and len(found[9]) == million // 8
    docs = spark.createDataFrame(list(enumerate(texts[:4])), "doc_id long, text string")
    assert {r.doc_id: r.n_ip for r in P.personal_data(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    score, ties = rng.normal(size=(6, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([1, 2, 3, 4, 4, 2])
    got = P.viterbi(score, ties, lengths)
    for i, n in enumerate(lengths):
        def value(path):
            walk = (0, *path, 0)
            return sum(score[i, t, y] for t, y in enumerate(path)) + sum(ties[a, b] for a, b in zip(walk, walk[1:]))
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert tuple(got[i, :n]) == best


def test_cutting_at_sure_words_changes_nothing(field):
    texts = [" ".join(w) for w, _ in P.template_sentences()] + [t or "" for t in TEXTS]
    labeller = P.Labeller(field)
    got = {}
    for text, place, label in labeller.labels(texts):
        got.setdefault(text, {})[place] = label
    for n, text in enumerate(texts):
        kinds = [P.features(s) for s in P.shapes(text)]
        if not kinds:
            continue
        feeds = (kinds, [P._EDGE, *kinds[:-1]], [*kinds[1:], P._EDGE])
        score = sum(field.weights[p][np.array(x)].sum(1) for p, x in enumerate(feeds))[None]
        want = P.viterbi(score, field.ties, np.array([len(kinds)]))[0]
        assert {i: int(y) for i, y in enumerate(want) if y} == got.get(n, {})


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    f = P.Field()
    f.ties = rng.normal(size=f.ties.shape)
    score = rng.normal(size=(2, 3, len(P.LABELS)))
    marginal, pairs = f._expected(score)

    def total(s, ties):
        out = 0
        for i in range(2):
            values = []
            for path in itertools.product(range(len(P.LABELS)), repeat=3):
                walk = (0, *path, 0)
                values.append(sum(s[i, t, y] for t, y in enumerate(path)) + sum(ties[a, b] for a, b in zip(walk, walk[1:])))
            out += np.logaddexp.reduce(values)
        return out

    step = 1e-5
    bumped = score.copy()
    bumped[1, 2, 3] += step
    assert marginal[1, 2, 3] == pytest.approx((total(bumped, f.ties) - total(score, f.ties)) / step, abs=1e-3)
    ties = f.ties.copy()
    ties[0, 2] += step
    assert pairs[0, 2] == pytest.approx((total(score, ties) - total(score, f.ties)) / step, abs=1e-3)


def test_held_out_accuracy():
    sentences = P.template_sentences()
    train, held = [s for n, s in enumerate(sentences) if n % 4], sentences[::4]
    labeller = P.Labeller(P.Field().fit(train))
    found = {(t, p): y for t, p, y in labeller.labels([" ".join(w) for w, _ in held])}
    hits = [found.get((n, p), 0) == y for n, (_, labels) in enumerate(held) for p, y in enumerate(labels)]
    assert sum(hits) / len(hits) >= 0.97


def test_added_spans(field):
    find = P.finder(field)()
    (_, phone), (_, none), (base, cards) = find([TEXTS[9], TEXTS[8], TEXTS[7]])
    assert none == [] and base == [] and [TEXTS[7][a:b] for _, a, b in cards] == ["4465758382889437"] * 2
    assert [(k, TEXTS[9][a:b]) for k, a, b in phone] == [("crf_phone", "(212) 555-7788")]


def test_empty(spark):
    assert P.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []

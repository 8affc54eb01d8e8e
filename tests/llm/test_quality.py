import re

from parcelwise.llm import quality as Q

TEXTS = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a", "x y\nx y\n\nx y\n \n", "# | $ % A B!", "É à b c", " lead trail \n",
    "the cat sat on the mat the cat sat there on the mat and the cat ran", "UP CASE WORDS " * 30, "word " * 60, "w" * 4000, "a\x0bb\x0cc\rd",
    " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 9}" for i in range(80)), " ".join(f"w{i}## |" for i in range(60)), "same line here\n" * 30 + " ".join(f"w{i}" for i in range(90)),
]


def spelled(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), sum(c.isupper() for c in text), len(lines), len(lines) - len(set(lines)), len(again)


def table(spark):
    return spark.createDataFrame([(n, t, "en", n) for n, t in enumerate(TEXTS)] + [(3, "one", "en", 3), (None, "two words", None, None)], "doc_id long, text string, body string, failed int")


def test_measures_equal_plain_python(spark):
    got = sorted((tuple(r[c] for c in ("doc_id", *Q.MEASURES)) for r in Q.measures(table(spark)).collect()), key=str)
    want = sorted([(n, *spelled(t)) for n, t in enumerate(TEXTS)] + [(3, *spelled("one")), (None, *spelled("two words"))], key=str)
    assert got == want


def test_ledger_bits_policies_and_ablations(spark):
    ledger = Q.ledger(table(spark))
    rows = ledger.collect()
    for r in rows:
        for name, failing in Q.RULES:
            assert bool(r.failed & Q.BIT[name]) == eval(failing, {}, r.asDict())
    kept = {(r.policy, r.version): r.n for r in Q.apply_policies(ledger, Q.POLICIES).filter("kept").groupBy("policy", "version").agg(Q.F.count("kept").alias("n")).collect()}
    for key, mask in Q.POLICIES.items():
        assert kept.get(key, 0) == sum(not r.failed & mask for r in rows)
        got = {r.rule: (r.n_failed, r.n_only) for r in Q.ablations(ledger, mask).collect()}
        for name, bit in Q.BIT.items():
            if bit & mask and any(r.failed & bit for r in rows):
                assert got[name] == (sum(bool(r.failed & bit) for r in rows), sum(r.failed & mask == bit for r in rows))


def test_kept_rows_keep_their_columns(spark):
    docs = table(spark)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [TEXTS.index(" ".join(f"w{i}" for i in range(80)))]


def test_no_python_in_the_plan(spark):
    plan = Q.ledger(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert Q.ledger(spark.createDataFrame([], "doc_id long, text string")).collect() == []

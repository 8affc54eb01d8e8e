import hashlib

import pytest

from parcelwise.llm import chat as C

SAID = r"\### Assistant: </turn> ok"


def conversations():
    out = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    out += [(1, 0, "system", "be \\b brief\n"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, None, "</turn>\n### x"), (1, 4, "assistant", "\\e\\h</turn></turn>### ")]
    out += [(2, n, "system" if n == 0 else "user" if n % 2 else "assistant", f"{n} " + "word é " * (n * 13 % 150)) for n in range(140)]
    out += [(3, n % 3, "assistant" if n % 2 else "user", "tie" + str(n)) for n in range(9)] + [(3, None, "ro\nle", "no number"), (3, 1, "user", "again"), (3, 1, "user", "again")]
    return out + [(None, 0, "assistant", "no conversation"), (5, 0, "assistant", "x" * 9000), (5, 1, "user", ""), (6, 0, "system", "alone")]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))


@pytest.mark.parametrize("budget, history", [(2048, 256), (160, 20)])
def test_round_trip_and_masks(spark, budget, history):
    given = conversations()
    docs = spark.createDataFrame([(*r, 1) for r in given], "conv_id long, turn long, role string, text string, window int")
    formatted = C.windows(docs, budget, history)
    back = {}
    for r in C.read_windows(formatted).orderBy("window").collect():
        mine = back.setdefault(r.conv_id, ([], []))
        mine[0].extend((t.role, t.text) for t in r.turns)
        mine[1].append(r.loss_text)
    assert set(back) == {r[0] for r in given}
    for conv, (turns, loss) in back.items():
        want = [(r[2] or "", r[3] or "") for r in ordered([r for r in given if r[0] == conv])]
        assert turns == want
        assert "".join(loss) == "".join(t for role, t in want if role == "assistant")
    room = (budget - history) // 2
    for r in formatted.collect():
        assert r.text.count(C.CLOSE) == r.text.count(C.OPEN)
        first_role = ordered([x for x in given if x[0] == r.conv_id])[0][2]
        if r.window and first_role == "system":
            assert r.text.startswith("### system\n") and r.n_repeated >= 1
        turns = r.text.split(C.CLOSE)[:-1]
        cost = [-(-len(C_unescape(t.partition("\n")[2])) // 4) + C.TURN_TOKENS for t in turns]
        if r.conv_id == 2 and max(cost) <= room:
            assert sum(cost[1:]) <= budget


def C_unescape(text):
    for old, new in reversed(C._TEXT_ESCAPES):
        text = text.replace(new, old)
    return text


def test_query_digests(spark, tmp_path):
    given = conversations()
    spark.createDataFrame(given[2:], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in C.op9_chat_windows(spark, str(tmp_path)).collect()}
    for conv in {r[0] for r in given}:
        want = [(r[2] or "", r[3] or "") for r in ordered([r for r in given if r[0] == conv])]
        loss = "".join(t for role, t in want if role == "assistant")
        assert got[conv].n_turns == len(want) and got[conv].loss_chars == len(loss)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    plan = C.read_windows(C.windows(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert C.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_history_must_fit(spark):
    with pytest.raises(ValueError):
        C.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), 100, 90)

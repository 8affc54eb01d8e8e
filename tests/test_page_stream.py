import json
import random
from collections import Counter

from parcelwise.sources import responses as R
from parcelwise.streaming.page_stream import PAGE_SCHEMA, start_page_stream


def _body(pnu, page, size, total):
    units = [{"pnu": pnu, "hoNm": f"{page}-{i}", "pblntfPc": "1,000"} for i in range(size)]
    return json.dumps({"apartHousingPrices": {"totalCount": total, "field": units}})


def test_pages_in_any_order_give_the_batch_rows(spark, tmp_path):
    rng = random.Random(3)
    error = json.dumps({"apartHousingPrices": {"resultCode": "SYSTEM_ERROR"}})
    pages = []
    for n in range(30):
        pnu, count = f"P{n}", rng.randint(1, 6)
        total = rng.choice([count * 3, count * 3 - 4, 0])
        for page in range(1, count + 1):
            kind = rng.random()
            if kind < 0.1 and page > 1:
                continue
            pages.append((pnu, "2026", page, error if kind < 0.2 else None if kind < 0.23 else _body(pnu, page, 3, total)))
    pages += [(None, "2026", 1, error), ("P0", None, 1, error), ("P1", "2026", 0, error), ("P2", "2026", None, error)]
    rng.shuffle(pages)
    inbox, output = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for start in range(2):
        # The second run goes on from the state of the first, and gets the pages of the last file again.
        for i, part in enumerate(pages[start * 3 + k::6] for k in range(3)):
            for name in [f"{start}{i}"] + (["again"] if start and i == 2 else []):
                (inbox / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("pnu", "year", "page", "body"), p))) for p in part))
        start_page_stream(spark, str(inbox), output, str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    got = Counter((r["pnu"], r["ho"]) for r in spark.read.parquet(output).collect())
    batch = R.reassemble(R.decode_price_bodies(spark.createDataFrame(pages, PAGE_SCHEMA)))
    assert got == Counter((r["pnu"], r["ho"]) for r in batch.where("pnu IS NOT NULL AND year IS NOT NULL").collect()) and len(got) > 40


def test_a_parcel_without_news_is_forgotten(spark, tmp_path):
    from parcelwise.streaming.page_stream import _advance
    import pandas as pd

    class State:
        exists, hasTimedOut, removed, duration = False, False, False, None

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.removed = True

        def setTimeoutDuration(self, value):
            self.duration = value

    state, run = State(), _advance(500)
    late = pd.DataFrame([(2, 1, 2, "[2]")], columns=["page", "got", "total", "rows"])
    assert [len(f) for f in run(("P", "Y"), [late], state)] == [0] and state.duration == 500
    first = pd.DataFrame([(1, 1, 2, "[1]")], columns=["page", "got", "total", "rows"])
    assert [f["rows"].tolist() for f in run(("P", "Y"), [first], state)] == [["[1]", "[2]"]] and state.get[3:] == (True, "{}")
    assert [len(f) for f in run(("P", "Y"), [first], state)] == [0]
    state.hasTimedOut = True
    assert list(run(("P", "Y"), [], state)) == [] and state.removed

import random

import corpus_pipeline as P
from parcelwise.llm.common import stored

rng = random.Random(21)
TEXT = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def write(spark, folder):
    item = TEXT(30) + "."
    copy = TEXT(120)
    rows = [(n, TEXT(rng.randint(60, 200)), "en", f"s{n % 3}", 1) for n in range(40)]
    rows += [(100, copy, "en", "s0", 1), (101, copy, "en", "s1", 1), (102, copy.title(), "en", None, 1), (103, "too short", "en", "s0", 1), (104, None, None, None, None)]
    rows += [(105, TEXT(80) + " " + item + " " + TEXT(50), "en", "s2", 1), (106, "### | " * 80, "en", "s1", 1), (107, "", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        seen.append(ids(docs))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen[0] == [*range(40), 100, 101, 102, 105]
    assert seen[1] == [*range(40), 100, 105]
    assert seen[2] == [*range(40), 100]
    assert set(seen[3]) <= set(seen[2]) and seen[4] == seen[3]
    assert ids(P.run(spark, str(tmp_path))) == seen[4]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []

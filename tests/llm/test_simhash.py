import glob
import random
import time

from pyspark.sql import functions as F

from parcelwise.llm import simhash as S
from parcelwise.session import shared_folder


def spelled(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [S.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(rows, bits):
    ids = [i for i, _ in rows]
    label = {n: n for n in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for n, i in enumerate(ids):
        if i is not None:
            least[label[n]] = min(i, least.get(label[n], i))
    return [least.get(label[n]) for n in range(len(ids))]


def sample():
    rng = random.Random(5)
    words = lambda n: [rng.choice("ab bc cd de ef Fg gh É".split()) + str(rng.randint(0, 9)) for _ in range(n)]
    base = words(80)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b"), (6, "a  B"), (7, "a b c"), (None, "x y z")]
    for n in range(10, 60):
        copy = base[:]
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(80)] = "new" + str(rng.randint(0, 3))
        rows.append((n, " ".join(copy)))
    rows += [(n, " ".join(words(rng.randint(3, 30)))) for n in range(60, 90)]
    return rows + [(61, rows[-29][1])]


def test_fingerprints_and_groups_equal_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    want_fp = [spelled(t) for _, t in rows]
    for bits in (0, 1, 2, 3):
        want = classes([(i, f) for (i, _), f in zip(rows, want_fp)], bits)
        got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.groups(docs, max_bits=bits).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(got, key=key) == sorted(zip([i for i, _ in rows], want_fp, want), key=key)


def test_every_flip_is_indexed():
    for bits in (0, 1, 2, 3):
        masks = S.variants(bits)
        rng = random.Random(bits)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for i in rng.sample(range(64), rng.randint(0, bits)):
                b ^= 1 << i
            assert any(a & m == b & m and (gap == 0 or (a ^ b) & gap) for m, gap in masks)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_rounds_of_components_leave_one_table(spark):
    tables = lambda: set(glob.glob(f"{shared_folder(spark)}/only-the-last-*"))
    edges, before = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"), tables()
    assert S.components(edges, "only-the-last").count() == 30
    assert len(tables() - before) == 1


def test_rounds_of_components_take_few_tasks(spark):
    def tasks(edges):
        edges = S.stored(edges, "edges")
        group = f"components-{time.time()}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            S.components(edges, "few-tasks")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
        return sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)

    setting = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        star = tasks(spark.range(1, 40).selectExpr("0L AS a", "id AS b"))
        chain = tasks(spark.range(8).selectExpr("id AS a", "id + 1 AS b"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", setting)
    assert star < 50
    assert chain < 150


def test_near_copies_leave_only_the_tables_their_result_reads(spark):
    tables = lambda: set(glob.glob(f"{shared_folder(spark)}/copies*"))
    before = tables()
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    rows = [(n, " ".join(base[:20] + [str(rng.randrange(10**6)) for _ in range(180)])) for n in range(5)]
    rows += [(n, " ".join(base[: n - 20] + ["x"] + base[n - 20 :])) for n in range(20, 30)]
    got = S.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {x.rsplit("/", 1)[1][:-33] for x in tables() - before}
    assert {r.doc_id: r.component_id for r in got.collect()} == {n: min(n, 20) for n, _ in rows}
    assert left <= {"copies", "copies-placed", "copies-simhash", "copies-prefixes"}


def test_stage_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        names = [found.apply(i).getName() for i in range(found.size())]
        return {n for n in names if n.startswith("shuffle_")}

    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before, counts = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = S.stored(counts, "counts")
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert sorted(r["count"] for r in table.collect()) == sorted(r["count"] for r in counts.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d", "s"), (1, "a b c d", "t"), (1, "a b c d", "t"), (None, "a b c d", "u"), (9, "other words here now", "s")], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.source) for r in S.keep_one(docs).collect()), key=str)
    assert got == [(1, "t"), (9, "s")]


def test_keep_one_of_rows_that_share_an_id(spark):
    """Ids are not unique: the group's smallest id may stand on rows of other groups too."""
    a, b, c = "one two three four five six", "quite another text of seven words here", "a third text that nobody else has written"
    docs = spark.createDataFrame([(0, b), (1, a), (1, b), (None, a), (None, c), (None, c), (2, None), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in S.keep_one(docs).collect()), key=str)
    assert got == sorted([(0, b), (1, a), (2, None), (None, c)], key=str)


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """Smallest id of each group linked by five-word similarities of 0.8 or more, by brute force."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return sorted(min(i for (i, _), x in zip(rows, label) if x == g) for g in set(label))


def test_keep_one_finds_similar_texts(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for base in ([word() for _ in range(rng.randint(40, 400))] for _ in range(25)):
        for _ in range(6):
            copy = base[:]
            for i in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 25))):
                copy[i] = word()
            rows.append(" ".join(copy))
    hot = [word() for _ in range(150)]
    rows += [" ".join(hot[:i] + [word()] + hot[i + 1 :]) for i in range(0, 150, 2)] + ["", "short one", "Short  one"]
    for k in (2, 3, 4, 5, 6, 9):  # farther copies of one text: some are linked to it, some only to each other, some to none
        for _ in range(12):
            copy = hot[:]
            for i in rng.sample(range(len(copy)), k):
                copy[i] = word()
            rows.append(" ".join(copy))
            if rng.random() < 0.5:
                copy[rng.randrange(len(copy))] = word()
                rows.append(" ".join(copy))
    shared = [word() for _ in range(60)]  # one long passage in texts of their own
    rows += [" ".join([word() for _ in range(rng.randint(10, 60))] + shared) for _ in range(80)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == kept(rows)


def test_empty(spark):
    assert S.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert S.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fingerprints_group_near_copies(spark, monkeypatch):
    """Texts a few bits apart are grouped by their fingerprints alone, and only if their shingles are similar enough."""
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n)]
    rows = [(n, " ".join(words(120))) for n in range(20)]
    fp = lambda text: S.fingerprint(S.np.unique(S.shingle_hashes(text.encode(), 5)))
    apart = lambda a, b: ((fp(a) ^ fp(b)) & (2**64 - 1)).bit_count()
    near = []
    for n, text in rows:
        for k in range(200):
            copy = f"{text} more{k}"
            if 1 <= apart(text, copy) <= 2:
                near.append((100 + n, copy))
                break
    assert len(near) > 10
    tiny = [(200, "one two three four five"), (201, "one two three four five six"), (202, None), (203, " ")]
    rows += near + [(300, rows[0][1].title())] + tiny
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = spark.createDataFrame([], "a long, size_a long, root_a long, b long, size_b long, root_b long")
    nothing = lambda *given: empty
    monkeypatch.setattr(S, "_leader_pairs", nothing)
    monkeypatch.setattr(S, "prefix_pairs", nothing)
    got = sorted(r.doc_id for r in S.keep_one(docs).collect())
    assert got == [*range(20), 200, 201, 202]


def test_fingerprint_pairs_keep_a_star_per_group(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(40)]
    fps = base + [b ^ 1 << rng.randrange(63) for b in base[:20]] + base[:10] + [base[0] ^ 1 << k for k in range(30)]
    nodes = [(n, 100 + n, fp) for n, fp in enumerate(fps)]
    pairs = S.fingerprint_pairs(spark.createDataFrame(nodes, "node long, size long, fp long")).collect()
    assert len(pairs) <= 2 * len(nodes) and all(r.size_a == 100 + r.a and r.size_b == 100 + r.b for r in pairs)
    label = classes([(n, f) for n, _, f in nodes], 2)
    joined = {r.node: r.root for r in S.components(spark.createDataFrame([(r.a, r.b) for r in pairs], "a long, b long")).collect()}
    assert [joined.get(n, n) for n, _, _ in nodes] == label


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entries_of_fingerprints_are_never_broadcast(spark):
    few = spark.range(1000).selectExpr("xxhash64(id) AS fp")
    assert "BroadcastHashJoin" not in plan(S.links(few))


def test_rows_per_key_are_never_broadcast(spark):
    now = spark.range(1000).selectExpr("id % 50 AS key", "id AS node", "id AS size", "id AS popular", "id AS root")
    assert "BroadcastHashJoin" not in plan(S._leader_pairs(now, 0))
    live, bodies = spark.range(1000).selectExpr("id AS node", "id AS root"), spark.range(1000).selectExpr("id AS node", "cast(cast(id AS string) AS binary) AS body")
    assert "BroadcastHashJoin" not in plan(S.prefix_pairs(live, bodies, 0.8, 5))

"""SimHash near-duplicates by deletion-variant signatures, and near copies by the similarity of their shingles.

A 64-bit fingerprint is cut into ``max_bits // 2 + 1`` segments.  Of two fingerprints at most ``max_bits``
bits apart, one segment then differs by at most one bit.  Every distinct fingerprint is indexed under

* each segment as it is, with one of ``max_bits + 1`` pieces of the other bits (one of them must be equal), and
* each segment with one bit left out, with one of ``max_bits`` pieces of the other bits.

Equal keys are candidates.  In the second kind the bit left out must be 0 on one side and 1 on the other, so
a pair meets once per variant and not in every variant of an equal segment.  Candidates are verified by
counting differing bits.  The pieces keep a bucket small (about 48 key bits) whatever the number of rows.

Exact copies never form pairs: the index holds distinct fingerprints.

The pipeline's near copies (``keep_one``) are texts whose five-word shingles have a similarity of 0.8 or more.  The texts are
grouped by their SimHash fingerprints in the same way, and every text is counted exactly against its group's leader.  Of the
pairs at 0.8 many lie farther apart than any distance the index can take (about 10 of 64 bits): what the fingerprints leave
in different groups then meets through min-hash bands and an exact prefix filter, and is counted exactly too.

Edge cases: a null or blank text has fingerprint 0 and is linked like any other; repeated rows stay rows; null
ids are ignored when the smallest id is taken (null if a group has no other); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column, prepare, read_table, remove, stored

BITS = 64
SEED = 42
#: The pipeline's near copies: words of a shingle and least Jaccard similarity.
COPY_WORDS = 5
LEAST_SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 4
LEADER_ROUNDS = 2
COPY_BITS = 2
PAIRS_PER_BODY = 64


def shingle_hashes(text: bytes | None, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words; the whole sequence if it is shorter."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= words_per_shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    count = len(words) - words_per_shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    return np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), "<u8", count)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it, as a signed long."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, words_per_shingle)) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    source = docs.select(column(docs, id_column, "bigint").alias("doc_id"), column(docs, text_column, "binary").alias("body"))
    return source.mapInArrow(run, "doc_id bigint, fp bigint")


def _ones(low: int, high: int) -> int:
    return ((1 << (high - low)) - 1) << low


def _pieces(mask: int, count: int) -> list[int]:
    """Cut the set bits of a mask into ``count`` masks of about equal size."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    cuts = [round(j * len(bits) / count) for j in range(count + 1)]
    return [sum(1 << b for b in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def variants(max_bits: int) -> list[tuple[int, int]]:
    """(mask of the key bits, the bit left out or 0) for every index entry."""
    count = max_bits // 2 + 1
    cuts = [round(j * BITS / count) for j in range(count + 1)]
    whole = _ones(0, BITS)
    out = []
    for low, high in zip(cuts, cuts[1:]):
        segment = _ones(low, high)
        out += [(segment | piece, 0) for piece in _pieces(whole & ~segment, max_bits + 1)]
        if max_bits:
            out += [(segment & ~(1 << i) | piece, 1 << i) for i in range(low, high) for piece in _pieces(whole & ~segment, max_bits)]
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``max_bits`` bits apart.

    Spark sizes the entries like the few fingerprints they are exploded from and would broadcast them; the hint keeps them distributed.
    """
    index = F.array(*[F.struct(F.lit(n).alias("v"), F.lit(_signed(m)).cast("bigint").alias("mask"), F.lit(_signed(b)).cast("bigint").alias("gap")) for n, (m, b) in enumerate(variants(max_bits))])
    entries = fps.select("fp").distinct().select("fp", F.explode(index).alias("e")).select(
        F.col("e.v").alias("v"), F.col("fp").bitwiseAND(F.col("e.mask")).alias("key"), "fp",
        F.when(F.col("e.gap") == 0, F.lit(2)).when(F.col("fp").bitwiseAND(F.col("e.gap")) == 0, F.lit(0)).otherwise(F.lit(1)).alias("side"))
    left = entries.filter("side != 1").select("v", "key", F.col("fp").alias("a"), F.col("side").alias("left_side"))
    right = entries.filter("side != 0").select("v", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = left.join(right.hint("merge"), ["v", "key"]).filter(near & ((F.col("left_side") == 0) | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), by alternating star contractions.

    Each round hangs neighbours on the smallest one they know, until every node has no more than one smaller neighbour
    and is not itself one; a round is written to the shared folder, so a lost executor never replays earlier rounds, and
    takes the place of the one before.  Groups are only aggregated and joined, never gathered.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    while True:
        both = _rows(now, ("u", "v"), ("v", "u"))
        known = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("smaller"), F.max(F.col("v") > F.col("u")).alias("larger"))
        known = stored(known, f"{name}-nodes")
        if known.filter("smaller > 1 OR smaller > 0 AND larger").isEmpty():
            remove(known)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = now.join(known.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        last, now = now, stored(_rows(large.join(below, "u"), ("u", "m"), ("v", "m")).filter("u != v").distinct(), name)
        remove(last)
        remove(known)


def _rows(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): for every row one of each pair of its columns."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("x")).select("x.u", "x.v")


def linked(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints with ``root``, the smallest one reachable over links of at most ``max_bits`` bits."""
    found = components(links(distinct, max_bits), "simhash-components")
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def groups(docs: DataFrame, max_bits: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest id among the rows reachable over links."""
    rows = stored(fingerprints(docs, words_per_shingle), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = stored(linked(distinct, max_bits), "simhash-placed")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, words_per_shingle: int = COPY_WORDS) -> DataFrame:
    """(doc_id, at, node, size, fp, keys) for every row: hash of the row, of its words, distinct shingles, their fingerprint, a key per band.

    A band's key is made of ``BAND_ROWS`` min-hashes of the shingles, so two texts share it with (similarity **
    ``BAND_ROWS``); texts of 0.8 share none of the ``BANDS`` keys in 3 of a million cases.
    """
    prepare(docs.sparkSession)
    rng = np.random.default_rng(SEED)
    turns, factors = (rng.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) for _ in range(2))
    factors = factors * np.uint64(2) + np.uint64(1)

    def keys(hashes: np.ndarray) -> list[int]:
        least = np.full(len(turns), np.iinfo(np.uint64).max)
        for low in range(0, len(hashes), 1024):
            least = np.minimum(least, ((hashes[low : low + 1024] ^ turns) * factors).min(1))
        return [xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, BAND_ROWS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, fps, found = [], [], [], []
            for text in batch.column("body").to_pylist():
                hashes = np.unique(shingle_hashes(text, words_per_shingle)).astype(np.uint64)
                nodes.append(xxh64_intdigest(b" ".join((text or b"").lower().split()), SEED))
                sizes.append(len(hashes))
                fps.append(fingerprint(hashes))
                found.append(np.array(keys(hashes) if len(hashes) else [], np.uint64).view(np.int64))
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), node, pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "at", "node", "size", "fp", "keys"])

    return _hashed(docs).mapInArrow(run, "doc_id bigint, at bigint, node bigint, size bigint, fp bigint, keys array<bigint>")


def _hashed(docs: DataFrame) -> DataFrame:
    doc_id, text = column(docs, "doc_id", "bigint"), column(docs, "text", "binary")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("at"), text.alias("body"))


def similar(pairs: DataFrame, bodies: DataFrame, least: float, words_per_shingle: int = COPY_WORDS) -> DataFrame:
    """The pairs (a, b) of nodes whose distinct shingles have a Jaccard similarity of ``least`` or more, counted exactly.

    A node with many pairs is spread: its body is handed out once per ``PAIRS_PER_BODY`` pairs.
    """
    spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_BODY).cast("int").alias("salts"))
    left = bodies.join(spread, bodies["node"] == spread["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("body").alias("body_a"))
    right = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b").join(bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine = None, np.zeros(0, "<u8")
        for batch in batches:
            keep = []
            for a, body_a, body_b in zip(*(batch.column(c).to_pylist() for c in ("a", "body_a", "body_b"))):
                if a != known:
                    known, mine = a, np.unique(shingle_hashes(body_a, words_per_shingle))
                other = np.unique(shingle_hashes(body_b, words_per_shingle))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(both >= least * (len(mine) + len(other) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return right.join(left, ["a", "salt"]).select("a", "b", "body_a", "body_b").mapInArrow(run, "a bigint, b bigint")


def _candidates(pairs: DataFrame, met: DataFrame | None, least: float) -> DataFrame:
    """Distinct pairs of different groups and of sizes that can be similar, without those that have met."""
    fits = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9
    pairs = pairs.filter((F.col("root_a") != F.col("root_b")) & fits).groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.struct("a", "b")).alias("p"))
    if met is not None:
        pairs = pairs.join(met, ["low", "high"], "left_anti")
    return pairs.select("p.a", "p.b")


def fingerprint_pairs(nodes: DataFrame, max_bits: int = COPY_BITS) -> DataFrame:
    """Every text with the leaders of its fingerprint and of its SimHash group; ``nodes`` has (node, size, fp).

    A group is that of ``groups``: fingerprints reachable over links of at most ``max_bits`` bits.  Its leader has the
    fingerprint of most texts.
    """
    distinct = nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("size", "node")).alias("head"))
    placed = stored(linked(distinct, max_bits), "copies-simhash")
    leaders = placed.groupBy("root").agg(F.max(F.struct("n", "head"))["head"].alias("leader"), F.sum("n").alias("texts")).filter("texts > 1")
    texts = nodes.join(placed.join(leaders, "root").select("fp", "head", "leader"), "fp")
    both = texts.select("node", "size", F.explode(F.array("head", "leader")).alias("head")).filter("node != head.node")
    return both.select(F.col("head.node").alias("a"), F.col("head.size").alias("size_a"), F.col("head.node").alias("root_a"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("node").alias("root_b"))


def _leader_pairs(now: DataFrame, turn: int) -> DataFrame:
    """Every text of a key with the key's leader: its most popular text, after the first turn one outside its largest group."""
    member = F.struct("popular", "node", "size", "root")
    if turn == 0:
        heads = now.groupBy("key").agg(F.max(member).alias("head"))
    else:
        counted = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max(member).alias("head"))
        major = counted.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        heads = counted.join(major, "key").filter("root != major").groupBy("key").agg(F.max("head").alias("head"))
    return now.join(heads.hint("merge"), "key").select(
        F.col("head.node").alias("a"), F.col("head.size").alias("size_a"), F.col("head.root").alias("root_a"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))


def prefix_pairs(live: DataFrame, bodies: DataFrame, least: float, words_per_shingle: int) -> DataFrame:
    """Pairs of texts of different groups that an exact prefix filter leaves; ``live`` has (node, root).

    Shingles are ordered by how many texts have them, rarest first.  Of two similar sets, each has a common shingle among
    its first ``size - ceil(least * size) + 1``, and the place of a common one bounds how many more there can be.  What a
    text has to itself comes first and is only counted, so texts that share no more than a common passage, or that differ
    in too many places of their own, never meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(shingle_hashes(t, words_per_shingle)).view(np.int64) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array([len(g) for g in grams], pa.int64()), pa.array(grams, pa.list_(pa.int64()))], ["node", "root", "size", "grams"])

    texts = bodies.join(live, "node").select("node", "root", "body").mapInArrow(run, "node bigint, root bigint, size bigint, grams array<bigint>")
    tokens = stored(texts.select("node", "root", "size", F.explode("grams").alias("gram")), "copies-grams")
    common = tokens.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = tokens.join(common.hint("merge"), "gram").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("shared"))
    alone, prefix = F.col("size") - F.size("shared"), F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    front = held.filter(alone < prefix).select("node", "root", "size", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))).alias("k", "x"))
    front = stored(front.select(F.col("x.gram").alias("gram"), "node", "root", "size", (F.col("size") - F.col("alone") - F.col("k")).alias("rest")), "copies-prefixes")
    remove(tokens)
    left, right = (front.select("gram", F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("size").alias(f"size_{x}"), F.col("rest").alias(f"rest_{x}")) for x in "ab")
    enough = F.least("rest_a", "rest_b") >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-9
    return left.join(right.hint("merge"), (left["gram"] == right["gram"]) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & enough)


def near_copies(docs: DataFrame, least: float = LEAST_SIMILARITY, words_per_shingle: int = COPY_WORDS, max_bits: int = COPY_BITS) -> DataFrame:
    """(doc_id, at, component_id, group) per row: the smallest id among the rows reachable over similar texts, and the group's own name.

    First every text meets the leaders of its fingerprint and of its SimHash group.  What that leaves in different groups meets
    by the keys of bands: every text of a key meets the key's leader, in ``LEADER_ROUNDS`` turns with another one each; what is
    one group by then needs no more pairs.  Texts of keys that still hold several groups then meet through an exact prefix
    filter, so no pair is left out, and a large group does not make the square of its size.

    Tables with a row per key or shingle are sized far too low by Spark; hints keep them from a broadcast.
    """
    rows = stored(sketches(docs, words_per_shingle), "copies")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("at").alias("at"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "copies-nodes")
    by_fingerprint = stored(_candidates(fingerprint_pairs(nodes.select("node", "size", "fp"), max_bits), None, least), "copies-pairs")
    entries = nodes.select(F.explode("keys").alias("key"), "node", "size")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = stored(entries.join(shared.hint("merge"), "key"), "copies-keys")
    popular = counted.groupBy("node").agg(F.sum("n").alias("popular"))
    wanted = popular.select("node").unionByName(by_fingerprint.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(nodes, "node").select("node", "at")
    bodies = stored(_hashed(docs).select("at", "body").join(wanted, "at").select("node", "body").dropDuplicates(["node"]), "copies-bodies")
    entries = stored(counted.join(popular, "node").select("key", "node", "size", "popular"), "copies-entries")
    remove(counted)
    met = labels = None
    compared = []
    for turn in range(-1, LEADER_ROUNDS + 1):
        if turn < 0:
            pairs = by_fingerprint
        else:
            now = entries.withColumn("root", F.col("node"))
            if labels is not None:
                now = entries.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
            if turn < LEADER_ROUNDS:
                both = _leader_pairs(now, turn)
            else:
                open_keys = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
                both = prefix_pairs(now.join(open_keys, "key", "left_semi").select("node", "root").distinct(), bodies, least, words_per_shingle)
            pairs = stored(_candidates(both, met, least), "copies-pairs")
        compared.append(pairs)
        met_now = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        met = met_now if met is None else met.unionByName(met_now)
        found = stored(similar(pairs, bodies, least, words_per_shingle), "copies-links")
        if not found.isEmpty():
            edges, last = found, labels
            if last is not None:  # what was linked before is one group by its labels
                edges = found.unionByName(last.select(F.col("node").alias("a"), F.col("root").alias("b")))
            labels = components(edges, "copies-components")
            if last is not None:
                remove(last)
        remove(found)
    placed = nodes.select("node", "first").withColumn("root", F.col("node"))
    if labels is not None:
        placed = nodes.select("node", "first").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed, "copies-placed")
    for table in [nodes, bodies, entries, *compared] + ([] if labels is None else [labels]):
        remove(table)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(placed.join(smallest, "root").select("node", F.col("root").alias("group"), "component_id"), "node").select("doc_id", "at", "component_id", "group")


def keep_one(docs: DataFrame, least: float = LEAST_SIMILARITY, words_per_shingle: int = COPY_WORDS, max_bits: int = COPY_BITS) -> DataFrame:
    """One row of each group of near copies, in the columns of ``docs``: of the rows with its smallest id, that of the smallest hash.

    A null id comes after all others, so a group keeps a row without an id only where none of its rows has one.
    """
    found = near_copies(docs, least, words_per_shingle, max_bits)
    keep = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("x")).select(F.col("x.at").alias("_at"))
    marked = docs.withColumn("_at", F.xxhash64(column(docs, "doc_id", "bigint"), column(docs, "text", "binary")))
    return marked.join(keep, "_at", "left_semi").dropDuplicates(["_at"]).select(*docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}

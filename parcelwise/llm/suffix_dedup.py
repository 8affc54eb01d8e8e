"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte is removed if a string of ``length`` bytes that covers it starts at two places of the input or more.
Matches never cross documents.

1. *Anchors.*  Every ``length``-byte window names one position in it: that of the smallest hash among the
   ``prefix``-byte strings inside (the leftmost of equal ones).  Equal windows name equal positions, so two
   copies of a string share an anchor at the same offset.  About one position in 85 is an anchor.
2. *Candidates.*  Anchors whose ``prefix``-byte string occurs once cannot be shared and go; counting them
   combines before the shuffle.
3. *Sorted runs.*  A task takes the suffixes at its anchors (``length`` bytes onwards, then the bytes before
   the anchor, backwards), sorts them and writes them front-coded: each suffix gives the length of the prefix
   it shares with the one before and the rest.  Copies cost nothing but their position.
4. *Merge.*  Runs are exchanged by the hash of their first ``prefix`` bytes and merged by a loser tree.  A tree
   node keeps how long a prefix its loser shares with the last winner, so known prefixes are never compared
   again, and the merged stream knows the common prefix of neighbours.
5. *Windows.*  At offset ``o`` before an anchor, two suffixes hold the same window if they share ``length - o``
   bytes onwards (runs of the merged order) and ``o`` bytes backwards (runs of the order of the backward parts).
   Both are exact.  An anchor's repeated windows all cover the anchor, so its removed bytes are one interval.
6. The intervals of a document are united and cut out.

A prefix with more than ``hot_group`` anchors is not gathered: its windows become rows keyed by a 128-bit digest,
which Spark counts before and after a shuffle and joins back.

Edge cases: null text is empty; texts shorter than ``length`` stay; repeated rows are copies of one another and
are removed whole (if long enough); null ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare, read_table, remove, stored

LENGTH = 200
PREFIX = 32
#: Anchors with one prefix that a merge task may gather; at some 600 bytes each this is 150 MB.
HOT_GROUP = 250_000
#: Bytes hashed at a time.
STEP = 1 << 18
#: Suffixes a sorted run may hold.
RUN_ROWS = 60_000
#: Suffixes whose windows are compared at a time; groups are never cut.
CHUNK_ROWS = 40_000
_POSITION_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, "<u8")
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchors of texts; hash tables are built once per task."""

    def __init__(self, length: int, prefix: int):
        self.length, self.prefix = length, prefix
        most = STEP + 2 * length
        self.up = _powers(_BASE, most)
        self.down = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), most)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of every ``prefix``-byte string of the buffer."""
        n, k = len(data), self.prefix
        total = np.zeros(n + 1, "<u8")
        np.cumsum((data.astype("<u8") + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h

    def of_buffer(self, data: np.ndarray, pieces: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the buffer, hashes) for the windows that lie inside one of the pieces (start, end)."""
        width = self.length - self.prefix + 1
        h = self.hashes(data)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        least = (h & ~low) | np.arange(len(h), dtype="<u8")
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        starts = np.zeros(len(least), bool)
        for a, b in pieces:
            starts[a : max(a, b - self.length + 1)] = True
        hit = np.zeros(len(h), bool)
        hit[(least[starts] & low).astype(np.int64)] = True
        at = np.flatnonzero(hit)
        return at, h[at]

    def of_texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the text, positions, hashes); a text may come in several parts."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for n, text in enumerate(texts):
            if len(text) < self.length:
                continue
            for start in range(0, len(text) - self.length + 1, STEP - self.length + 1):
                part = text[start : start + STEP]
                if size + len(part) > STEP and held:
                    yield from self._flush(held)
                    held, size = [], 0
                held.append((n, start, part))
                size += len(part)
        if held:
            yield from self._flush(held)

    def _flush(self, held: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        bounds = np.concatenate([[0], np.cumsum([len(p) for _, _, p in held])]).tolist()
        at, h = self.of_buffer(np.frombuffer(b"".join(p for _, _, p in held), "u1"), list(zip(bounds, bounds[1:])))
        cuts = np.searchsorted(at, bounds)
        for (n, start, _), base, a, b in zip(held, bounds, cuts, cuts[1:]):
            if b > a:
                yield n, at[a:b] - base + start, h[a:b]


def _source(docs: DataFrame) -> DataFrame:
    """Rows with a key of (id, hash of the text): rows that agree in both hold the same bytes."""
    body = F.coalesce(column(docs, "text", "binary"), F.lit(b""))
    return docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), body.alias("body")).withColumn("id_key", F.coalesce("doc_id", F.lit(0).cast("bigint"))).withColumn("text_key", F.xxhash64("body"))


def packed(docs: DataFrame) -> DataFrame:
    """Rows with compressed bodies: texts cross a shuffle twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = pa.array([packer.compress(b) for b in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "id_key", "text_key")), bodies], ["doc_id", "id_key", "text_key", "packed"])

    return docs.select("doc_id", "id_key", "text_key", "body").mapInArrow(run, "doc_id bigint, id_key bigint, text_key bigint, packed binary")


def unpacked(column: pa.Array) -> list[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(b) for b in column.to_pylist()]


def anchors(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """(id_key, text_key, pos, h) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, prefix)
        for batch in batches:
            ids, texts = np.asarray(batch.column("id_key")), np.asarray(batch.column("text_key"))
            found = list(finder.of_texts(batch.column("body").to_pylist()))
            if not found:
                continue
            rows = np.repeat([n for n, _, _ in found], [len(p) for _, p, _ in found])
            pos, h = np.concatenate([p for _, p, _ in found]).astype(np.int64), np.concatenate([h for _, _, h in found]).view("<i8")
            # Parts of a long text overlap and may name an anchor twice.
            order = np.lexsort((pos, rows))
            order = order[np.append(True, (np.diff(rows[order]) != 0) | (np.diff(pos[order]) != 0))]
            rows = rows[order]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(texts[rows]), pa.array(pos[order]), pa.array(h[order])], ["id_key", "text_key", "pos", "h"])

    return docs.mapInArrow(run, "id_key bigint, text_key bigint, pos bigint, h bigint")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    end = min(len(a), len(b))
    while known < end:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            size = min(len(x), len(y))
            gap = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return known + (size - (gap.bit_length() + 7) // 8 if gap else size)
        known += len(x)
    return end


# --- front-coded runs ---------------------------------------------------------------------------------------

_META = (("id_key", "<i8"), ("text_key", "<i8"), ("pos", "<i8"), ("ahead", "<u2"), ("behind", "<u2"))


def encode_run(keys: list[bytes], meta: dict[str, np.ndarray]) -> bytes:
    """Sorted suffixes as shared prefix lengths, rest lengths, rests and the positions."""
    shared, rest, last = [], [], b""
    for key in keys:
        same = common_prefix(last, key, 0) if key != last else len(key)
        shared.append(same)
        rest.append(key[same:])
        last = key
    parts = [np.array([len(keys)], "<i8").tobytes(), np.array(shared, "<u2").tobytes(), np.array([len(r) for r in rest], "<u2").tobytes()]
    parts += [meta[name].astype(kind).tobytes() for name, kind in _META]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts + rest))


def decode_run(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes, dict[str, np.ndarray]]:
    """(shared, rest lengths, rests, positions)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
    out = []
    for kind in ("<u2", "<u2", *(kind for _, kind in _META)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out[0], out[1], raw[at:], {name: column for (name, _), column in zip(_META, out[2:])}


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, bytes]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(suffix, prefix shared with the one before, run, row) in order, by a loser tree.

    ``ahead[r]`` is the prefix that the head of run ``r`` shares with the last suffix put out.  Of two heads the
    one that shares more is smaller; only where both share the same are bytes compared, from there on.
    """
    heads: list[bytes | None] = []
    feeds = []
    for shared, sizes, rest in runs:
        feeds.append((shared.tolist(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist(), rest))
        heads.append(rest[: feeds[-1][1][1]] if len(shared) else None)
    row = [0] * len(runs)
    ahead = [0] * len(runs)

    def smaller(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if ahead[a] != ahead[b]:
            return (a, b) if ahead[a] > ahead[b] else (b, a)
        same = common_prefix(x, y, ahead[a])
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            ahead[b] = same
            return a, b
        ahead[a] = same
        return b, a

    size = 1
    while size < len(runs):
        size *= 2
    heads += [None] * (size - len(runs))
    ahead += [0] * (size - len(runs))
    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = smaller(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner] is not None:
        key = heads[winner]
        yield key, ahead[winner], winner, row[winner]
        shared, ends, rest = feeds[winner]
        row[winner] = n = row[winner] + 1
        if n < len(shared):
            heads[winner] = key[: shared[n]] + rest[ends[n] : ends[n + 1]]
            ahead[winner] = shared[n]
        else:
            heads[winner] = None
        node = (winner + size) // 2
        while node:
            winner, losers[node] = smaller(winner, losers[node])
            node //= 2


def repeated_offsets(keys: list[bytes], shared: np.ndarray, ahead: np.ndarray, behind: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset at which a suffix's window occurs again (largest -1: none).

    ``keys`` are sorted suffixes, padded to ``length`` bytes and followed by the bytes before them backwards.
    """
    most = length - prefix
    same = np.zeros(len(keys), bool)  # equal to the suffix before in both directions
    same[1:] = (shared[1:] >= [len(k) for k in keys[1:]]) & (ahead[1:] == ahead[:-1]) & (behind[1:] == behind[:-1]) & [len(a) == len(b) for a, b in zip(keys, keys[1:])]
    first = np.flatnonzero(~same)
    copies = np.diff(np.append(first, len(keys)))
    low = np.full(len(first), most + 1)
    high = np.full(len(first), -1)
    on, back = ahead[first].astype(np.int64), behind[first].astype(np.int64)
    least, largest = np.maximum(0, length - on), np.minimum(back, most)
    whole = (copies > 1) & (least <= largest)
    low[whole], high[whole] = least[whole], largest[whole]
    # Right runs: neighbours of different cells share at least the smallest shared prefix between them.
    right = np.minimum(shared[first], length).astype(np.int64)
    tails = [keys[i][length:] for i in first]
    order = sorted(range(len(first)), key=tails.__getitem__)
    left = np.zeros(len(first), np.int64)
    left[1:] = [common_prefix(tails[a], tails[b], 0) for a, b in zip(order, order[1:])]
    inverse = np.empty(len(first), np.int64)
    inverse[order] = np.arange(len(first))
    for o in range(most + 1):
        able = (on >= length - o) & (back >= o)
        if np.count_nonzero(able) < 2:
            continue
        runs = np.cumsum(right < length - o) * (len(first) + 1) + np.cumsum(left < o)[inverse]
        rows = np.flatnonzero(able)
        mine = runs[rows]
        by = np.argsort(mine, kind="stable")
        ranked = mine[by]
        twin = np.zeros(len(rows), bool)
        equal = ranked[1:] == ranked[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        hit = rows[by[twin]]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
    return np.repeat(low, copies), np.repeat(high, copies)


# --- the job --------------------------------------------------------------------------------------------------

_SPANS = "id_key bigint, text_key bigint, low bigint, high bigint"


def repeated_spans(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, hot_group: int = HOT_GROUP) -> DataFrame:
    """(id_key, text_key, low, high): byte intervals to remove, several per document, overlapping."""
    spark = docs.sparkSession
    parts = max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = stored(anchors(docs.select("id_key", "text_key", "body"), length, prefix), "suffix-anchors")
    shared = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-shared")
    places = found.join(shared.select("h", (F.col("n") > hot_group).alias("hot")), "h")
    per_doc = places.groupBy("id_key", "text_key").agg(F.collect_set(F.struct("pos", "h", "hot")).alias("places"))
    bodies = packed(docs).select("id_key", "text_key", "packed").join(per_doc, ["id_key", "text_key"])
    any_hot = not shared.filter(F.col("n") > hot_group).isEmpty()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for id_key, text_key, body, here in zip(batch.column("id_key").to_pylist(), batch.column("text_key").to_pylist(), unpacked(batch.column("packed")), batch.column("places").to_pylist()):
                for at in here:
                    if at["hot"]:
                        continue
                    pos = at["pos"]
                    on, back = body[pos : pos + length], body[max(0, pos - length + prefix) : pos][::-1]
                    held.append((at["h"] % parts, on + b"\xff" * (length - len(on)) + back, id_key, text_key, pos, len(on), len(back)))
                if len(held) >= RUN_ROWS:
                    yield _run_batch(held)
                    held = []
        if held:
            yield _run_batch(held)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        decoded = [decode_run(b) for b in group["run"]]
        out: list[pd.DataFrame] = []
        keys: list[bytes] = []
        rows: list[tuple[int, int, int]] = []

        def flush() -> None:
            took = np.array(rows, np.int64)
            meta = {n: np.empty(len(rows), kind) for n, kind in _META}
            for r in np.unique(took[:, 1]):
                mine = took[:, 1] == r
                for n in meta:
                    meta[n][mine] = decoded[r][3][n][took[mine, 2]]
            low, high = repeated_offsets(keys, took[:, 0], meta["ahead"], meta["behind"], length, prefix)
            hit = high >= 0
            pos = meta["pos"][hit]
            out.append(pd.DataFrame({"id_key": meta["id_key"][hit], "text_key": meta["text_key"][hit], "low": pos - high[hit], "high": pos - low[hit] + length}))

        for key, same, run, row in merge_runs([(a, b, c) for a, b, c, _ in decoded]):
            if same < prefix and len(keys) >= CHUNK_ROWS:
                flush()
                keys, rows = [], []
            keys.append(key)
            rows.append((same, run, row))
        if keys:
            flush()
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id_key", "text_key", "low", "high")})

    spans = bodies.mapInArrow(runs, "part int, run binary").groupBy("part").applyInPandas(merge, _SPANS)
    if any_hot:
        spans = spans.unionByName(_hot_spans(bodies, length, prefix))
    spans = stored(spans, "suffix-spans")
    remove(found)
    return spans


def _run_batch(held: list[tuple]) -> pa.RecordBatch:
    held.sort(key=lambda x: x[:2])
    parts, runs = [], []
    at = 0
    while at < len(held):
        part, end = held[at][0], at
        while end < len(held) and held[end][0] == part:
            end += 1
        block = held[at:end]
        parts.append(part)
        runs.append(encode_run([x[1] for x in block], {name: np.array([x[n] for x in block], np.int64) for n, (name, _) in enumerate(_META, 2)}))
        at = end
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(runs, pa.binary())], ["part", "run"])


def _hot_spans(bodies: DataFrame, length: int, prefix: int) -> DataFrame:
    """The same intervals for prefixes too common to gather: windows as rows, counted by digest."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_key, text_key, body, here in zip(batch.column("id_key").to_pylist(), batch.column("text_key").to_pylist(), unpacked(batch.column("packed")), batch.column("places").to_pylist()):
                starts = sorted({s for at in here if at["hot"] for s in range(max(0, at["pos"] - length + prefix), min(at["pos"], len(body) - length) + 1)})
                for low in range(0, len(starts), 20_000):
                    some = starts[low : low + 20_000]
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[s : s + length]) for s in some), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([id_key] * len(some), pa.int64()), pa.array([text_key] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())],
                        ["id_key", "text_key", "start", "d1", "d2"])

    rows = stored(bodies.filter(F.exists("places", lambda p: p["hot"])).mapInArrow(windows, "id_key bigint, text_key bigint, start bigint, d1 bigint, d2 bigint"), "suffix-windows")
    again = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1", "d2")
    hit = rows.join(again, ["d1", "d2"], "left_semi")
    return hit.select("id_key", "text_key", F.col("start").alias("low"), (F.col("start") + length).alias("high"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching intervals."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def cut(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, hot_group: int = HOT_GROUP) -> DataFrame:
    """(doc_id, kept binary, removed array of (low, high), n_bytes) per row."""
    prepare(docs.sparkSession)
    source = _source(docs)
    spans = repeated_spans(source, length, prefix, hot_group)
    per_doc = spans.distinct().groupBy("id_key", "text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, sizes = [], [], []
            for body, spans in zip(unpacked(batch.column("packed")), batch.column("spans").to_pylist()):
                gone = united([(s["low"], s["high"]) for s in spans or ()])
                cuts = [0, *(x for span in gone for x in span), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                removed.append([{"low": a, "high": b} for a, b in gone])
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), pa.array(sizes, pa.int64())],
                ["doc_id", "kept", "removed", "n_bytes"])

    joined = packed(source).join(per_doc, ["id_key", "text_key"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id bigint, kept binary, removed array<struct<low:bigint,high:bigint>>, n_bytes bigint")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = cut(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}

"""Token ids as flat binary files.

A set of shards in one shared folder, read by memory mapping:

* ``<shard>.ids``: all token ids of the shard's documents, unsigned little-endian integers of the width the
  vocabulary needs (2 or 4 bytes), nothing between documents;
* ``<shard>.docs``: the documents' own ids, signed 64-bit, and one validity byte each behind them;
* ``<shard>.offsets``: ``documents + 1`` unsigned 64-bit offsets into the whole set, in ids.

Documents are range-partitioned by id, so shards are in ascending id order.  Each task encodes and appends
in bounded steps and returns one manifest row; the bases of the shards are prefix sums over the manifest, and
a second pass writes the offsets.  File names carry the attempt, and only names in the manifest count, so a
task that is run again after a loss leaves nothing wrong behind.

Edge cases: null text is an empty document (only the end id); null ids come first; rows that repeat an id lie
next to each other, ordered by text; an empty table gives no shards.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh_folder, open_folder, prepare, read_table, slices, stored

END_ID = 2
#: Distinct words whose ids a task keeps; the memory of words is emptied when full.
REMEMBERED_WORDS = 600_000
MANIFEST = "shard int, name string, folder string, width int, n_docs bigint, n_ids bigint"


#: What a tokenizer must do before merging for words to be encoded one by one.
_WORD_RULES = (
    ["NFC", "Replace", "Lowercase"],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)
#: Lower-case letters of old alphabets, and ASCII marks behind them.
_LETTERS = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u04ff]+)([!-/:-@\[-`{-~]*)")


class WordEncoder:
    """Ids of whole texts, each distinct word encoded once if the tokenizer allows that.

    A vocabulary file that lower-cases, and splits text at white space and between letters and marks before merging,
    gives a text the ids of its pieces in a row.  Pieces of letters that normalization leaves alone go straight to the
    merges; others are encoded in one text, and the offsets of the ids tell where each begins.  Any other file
    encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[bytes, bytes] = {}
        self.by_words = self._splits_words()
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _splits_words(self) -> bool:
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["normalizer"] or {}).get("normalizers", [])
        before = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != _WORD_RULES[0] or [x["type"] for x in before] != ["Split", "ByteLevel"] or before[1]["use_regex"] or before[1]["add_prefix_space"]:
            return False
        spaces = steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
        return spaces and before[0]["pattern"] == {"Regex": _WORD_RULES[1]} and before[0]["invert"] and before[0]["behavior"] == "Removed"

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian bytes."""
        if not self.by_words:
            return [self._whole(t.decode()) for t in texts]
        # Added tokens are found before lower-casing, so a text that may hold one keeps its case.
        pieces = [(t if b"<|" in t else t.lower()).replace(b"\n", b" ").split(b" ") for t in texts]
        missing = set().union(*pieces).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED_WORDS:
            self.known, missing = {}, set().union(*pieces)
        self._learn(missing)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in pieces]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, missing: set[bytes]) -> None:
        known = self.known
        marked: list[tuple[bytes, bytes, bytes]] = []
        words: set[str] = set()
        others: set[str] = set()
        for piece in missing:
            text = piece.decode()
            plain = _LETTERS.fullmatch(text)
            word = plain[1] if plain else ""
            if not (word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)):
                others.add(text)
                continue
            words.add(word)
            if plain[2]:
                # Letters and the marks behind them are always apart.
                others.add(plain[2])
                marked.append((piece, word.encode(), plain[2].encode()))
        self._learn_words([w for w in words if w.encode() not in known])
        self._learn_texts([p for p in others if p.encode() not in known])
        for piece, word, marks in marked:
            known[piece] = known[word] + known[marks]

    def _learn_words(self, words: list[str]) -> None:
        merge = self.tokenizer.model.tokenize
        code = "H" if self.width == 2 else "I"
        for run in slices(words, [len(w) for w in words], 1 << 16):
            shown = self.as_bytes.pre_tokenize_str(" ".join(run))[0][0].split("\u0120")  # what a space is shown as
            for word, symbols in zip(run, shown, strict=True):
                ids = [token.id for token in merge(symbols)]
                self.known[word.encode()] = struct.pack(f"<{len(ids)}{code}", *ids)

    def _learn_texts(self, texts: list[str]) -> None:
        plain = [p for p in texts if p and unicodedata.is_normalized("NFC", p)]
        for run in slices(plain, [len(p) for p in plain], 1 << 16):
            got = self.tokenizer.encode(" ".join(run), add_special_tokens=False)
            ids = np.array(got.ids, self.kind)
            starts = np.cumsum([0, *(len(p) + 1 for p in run)])
            cuts = np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), starts).tolist()
            for piece, a, b in zip(run, cuts, cuts[1:]):
                self.known[piece.encode()] = ids[a:b].tobytes()
        for piece in texts:
            if piece.encode() not in self.known:
                self.known[piece.encode()] = self._whole(piece)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode every row and write the file set; gives the manifest (shard, name, folder, width, n_docs, n_ids, base)."""
    spark = prepare(docs.sparkSession)
    folder = folder or fresh_folder(spark, "token-files")
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        system, path = open_folder(folder)
        name = uuid.uuid4().hex
        ids: list[np.ndarray] = []
        valid: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        with system.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in batches:
                doc_ids = batch.column("doc_id")
                ids.append(np.asarray(doc_ids.fill_null(0)).astype("<i8"))
                valid.append(np.asarray(doc_ids.is_valid()).astype(np.uint8))
                texts = [t or b"" for t in batch.column("body").to_pylist()]
                sizes = []
                for run in slices(texts, [len(t) for t in texts], 2 << 20):
                    for got in encoder.encode(run):
                        out.write(got + end)
                        sizes.append(len(got) // encoder.width + 1)
                counts.append(np.array(sizes, "<u8"))
        if not ids:
            return
        per_doc = np.concatenate(counts)
        with system.open_output_stream(f"{path}/{name}.docs") as out:
            out.write(np.concatenate(ids).tobytes() + np.concatenate(valid).tobytes())
        with system.open_output_stream(f"{path}/{name}.counts") as out:
            out.write(per_doc.tobytes())
        row = [TaskContext.get().partitionId(), name, folder, encoder.width, len(per_doc), int(per_doc.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                         ["shard", "name", "folder", "width", "n_docs", "n_ids"])

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, base in zip(*(batch.column(c).to_pylist() for c in ("name", "folder", "base"))):
                system, path = open_folder(at)
                with system.open_input_file(f"{path}/{name}.counts") as f:
                    per_doc = np.frombuffer(f.read(), "<u8")
                with system.open_output_stream(f"{path}/{name}.offsets") as out:
                    out.write((np.concatenate([[0], np.cumsum(per_doc)]).astype("<u8") + np.uint64(base)).tobytes())
            yield batch

    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "binary").alias("body"))
    ordered = source.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("body")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("body"), "body")
    parts = stored(ordered.mapInArrow(encode, MANIFEST), "token-parts")
    # One row per shard: the only thing that meets in one place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return stored(based.repartition(shards).mapInArrow(offsets, MANIFEST + ", base bigint"), "token-manifest")


def _mapped(system: arrow_fs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(system, arrow_fs.LocalFileSystem):
        return np.memmap(path, kind, mode="r") if system.get_file_info(path).size else np.zeros(0, kind)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shards = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, folder, width, n_docs in zip(*(batch.column(c).to_pylist() for c in ("name", "folder", "width", "n_docs"))):
                system, path = open_folder(folder)
                ids = _mapped(system, f"{path}/{name}.ids", f"<u{width}")
                at = _mapped(system, f"{path}/{name}.offsets", "<u8").astype(np.int64)
                raw = _mapped(system, f"{path}/{name}.docs", "u1")
                doc_ids, valid = raw[: 8 * n_docs].view("<i8"), raw[8 * n_docs :].astype(bool)
                for low in range(0, n_docs, 10_000):
                    high = min(n_docs, low + 10_000)
                    crc = [zlib.crc32(ids[at[i] - at[0] : at[i + 1] - at[0]].astype("<u4").tobytes()) for i in range(low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[low:high], mask=~valid[low:high]), pa.array(at[low:high]), pa.array(at[low + 1 : high + 1] - at[low:high]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(shards).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    return read(write(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}

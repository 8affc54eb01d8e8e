"""Spans of kinds in texts: what the searches for secrets and personal data share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare

Span = tuple[str, int, int]


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed."""
    rank = {k: n for n, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def byte_runs(data: bytes, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes in a class (256 flags) that are at least ``least`` long."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[np.frombuffer(data, "u1")]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def scan(docs: DataFrame, find: Callable[[], Callable[[list[str]], list[tuple[list[Span], list[Span]]]]], base: tuple[str, ...], added: tuple[str, ...]) -> DataFrame:
    """(doc_id, n_<base kind>, base_sha256, spans, found) per row.

    ``find()`` is called once per task and gives a function from texts to (base spans, added spans).
    """
    prepare(docs.sparkSession)
    kinds = base + added
    counts = [f"n_{k}" for k in base]
    schema = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in counts), "base_sha256 string, spans string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = find()
        for batch in batches:
            found = search([t or "" for t in batch.column("body").to_pylist()])
            arrays = [batch.column("doc_id")]
            arrays += [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in base]
            lines = [written(b, kinds) for b, _ in found]
            arrays += [pa.array([digest(x) for x in lines], pa.string()), pa.array([written(b + a, kinds) if a else x for (b, a), x in zip(found, lines)], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *counts, "base_sha256", "spans"])

    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("body"))
    return source.mapInArrow(run, schema)

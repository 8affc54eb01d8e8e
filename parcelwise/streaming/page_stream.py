"""Landed price pages arriving as files, in any order, put together as the batch job does."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import responses as R

PAGE_SCHEMA = "pnu string, year string, page int, body string"
_STATE = "next_page int, received bigint, total bigint, ended boolean, waiting string"
_USABLE = "pnu string, year string, page int, rows string"


def _advance(timeout_ms: int):
    """State function of one (parcel, year): pages that follow the last one given out without a gap, from page 1.

    The state holds where the reading stands and the pages that came too early.  It ends at an error, an empty page or
    the total page 1 announced; the mark stays until the timeout, so that pages sent again are not given out twice.
    """

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        next_page, received, total, ended, held = state.get if state.exists else (1, 0, 0, False, "{}")
        waiting = {int(page): tuple(rest) for page, rest in json.loads(held).items()}
        for frame in frames:
            for page, got, announced, rows in zip(frame["page"], frame["got"], frame["total"], frame["rows"]):
                if page >= next_page and not ended:
                    waiting[int(page)] = max(waiting.get(int(page), (-1, 0, "")), (int(got), int(announced), rows))
        out = []
        while not ended and next_page in waiting:
            got, announced, rows = waiting.pop(next_page)
            total = announced if next_page == 1 else total
            if got:
                out.append((*key, next_page, rows))
                received, next_page = received + got, next_page + 1
            ended = got == 0 or received >= total
        state.update((next_page, received, total, ended, json.dumps({} if ended else waiting)))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["pnu", "year", "page", "rows"])

    return run


def assembled_units(pages: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """Unit rows of a stream of landed pages (pnu, year, page, body), each given out once its turn has come.

    Once all pages are there, the rows are those of ``responses.reassemble``.  A page that comes more than once counts
    once; of those in one batch the one with most rows does.  Pages without a parcel, year or number are left out.  A
    parcel that gets no page for ``timeout_ms`` is forgotten, with the pages that wait behind its gap.
    """
    known = pages.where(F.col("pnu").isNotNull() & F.col("year").isNotNull() & (F.col("page") >= 1))
    decoded = R.decode_price_bodies(known).select(
        "pnu", "year", "page", F.coalesce(F.size("rows"), F.lit(0)).alias("got"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.to_json("rows"), F.lit("[]")).alias("rows")
    )
    usable = decoded.groupBy("pnu", "year").applyInPandasWithState(_advance(timeout_ms), _USABLE, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return R.explode_units(usable.withColumn("rows", F.from_json("rows", R.price_rows_schema())), "pnu", "year")


def start_page_stream(
    spark: SparkSession, pages_path: str, output_path: str, checkpoint_path: str, timeout_ms: int = 3_600_000, files_per_batch: int = 100
) -> StreamingQuery:
    """Append the units of landed pages below ``output_path``; stops when all files present have been read.

    Parcels that waited too long are forgotten with the next pages: batches without any would go on for ever.
    """
    pages = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(pages_path)
    units = assembled_units(pages, timeout_ms)
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # a query keeps the settings it starts with
    try:
        return units.writeStream.format("parquet").option("path", output_path).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)

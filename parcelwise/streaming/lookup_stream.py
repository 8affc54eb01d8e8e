"""Lookup requests arriving as files, answered by the batch lookup job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.lookup import Sources, lookup
from ..session import stored

REQUEST_SCHEMA = "request_id bigint, q string, dong string, ho string, pnu string"


def start_lookup_stream(
    spark: SparkSession, requests_path: str, output_path: str, checkpoint_path: str, sources: Sources, this_year: str, last_year: str,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Stateless enrichment of a file stream; every batch writes its own directory.

    A batch that is retried after a failure overwrites its directory, so each request is answered
    once.  Stops when all files present have been processed.
    """
    requests = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(requests_path)

    def answer(batch: DataFrame, batch_id: int) -> None:
        # Every row is answered, rows that repeat a request id too, so the lookup runs on a key of our own.
        rows = stored(batch.withColumn("_row", F.monotonically_increasing_id()), "stream-requests")
        found = lookup(rows.withColumn("request_id", F.col("_row")).drop("_row"), sources, this_year, last_year).withColumnRenamed("request_id", "_row")
        answers = found.join(rows.select("_row", "request_id"), "_row").select("request_id", *[c for c in found.columns if c != "_row"])
        answers.write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()

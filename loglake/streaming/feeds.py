"""Streaming ingest, live tail, event-time histograms and stateful alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.records import millis_ts
from ..model import LOG_SCHEMA
from ..operators.ingest import Ingestor
from ..plans.dsl import parse
from ..sources.wire import CORRUPT, parse_lines, to_logs


def landing(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Wire fields and ``_corrupt`` of lines that arrive as files in a folder; ``max_files`` a batch is the backpressure."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def ingest_stream(ingestor: Ingestor, path: str, checkpoint: str, every: str | None = None, report: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Ingests a landing folder batch by batch. A replayed batch finds its content in the catalog, so each row counts once.

    Without an interval it takes what there is and ends.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            done = ingestor.ingest(to_logs(rows.where(F.col(CORRUPT).isNull())))
            if report:
                report({"epoch": epoch, "ingested": done.ingested, "skipped": rows.where(F.col(CORRUPT).isNotNull()).count(), "files": done.files_written})
        finally:
            rows.unpersist()

    writer = landing(ingestor.store.spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def tail(spark: SparkSession, table_root: str, since_ms: int, query: str = "", now_ms: int = 0, max_files: int = 64) -> DataFrame:
    """Rows newer than a time, from all tiers' files as they appear, filtered by a search. Late and tied rows are not lost."""
    rows = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").parquet(table_root)
    rows = rows.where(F.col("ts") > millis_ts(F.lit(since_ms)))
    return rows.where(parse(query, now_ms).condition()) if query else rows


def tail_page(logs: DataFrame, since_ms: int, limit: int = 100) -> DataFrame:
    """One poll of a tail over rows at hand: the oldest ``limit`` rows newer than a time, with their times in milliseconds."""
    return logs.where(F.col("ts") > millis_ts(F.lit(since_ms))).orderBy("ts").limit(limit).withColumn("ts_millis", F.unix_millis(F.col("ts").cast("timestamp")))


def events(batch: DataFrame) -> Iterator[str]:
    """A batch as server-sent events; a comment if it is empty."""
    sent = False
    for row in batch.toJSON().toLocalIterator():
        sent = True
        yield f"data: {row}\n\n"
    if not sent:
        yield ": keep-alive\n\n"


def windowed(stream: DataFrame, width: str, late: str) -> DataFrame:
    """total and errors per event-time window; rows later than ``late`` are left out once their window is done."""
    # A watermark needs an instant; log times have no zone and count as UTC.
    bars = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return bars.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "ERROR").alias("errors")).select(F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "total", "errors")


def alert_states(evaluations: DataFrame, threshold: float) -> DataFrame:
    """State and transition of each evaluation (rule, eval_ms, v), the state of a rule kept across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else "ok"
        rows = pd.concat(list(frames)).sort_values("eval_ms")
        out = []
        for row in rows.itertuples():
            now = "firing" if row.v > threshold else "ok"
            out.append((key[0], row.eval_ms, row.v, now, "unchanged" if now == last else "fired" if now == "firing" else "resolved"))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["rule", "eval_ms", "v", "state", "transition"])

    return evaluations.groupBy("rule").applyInPandasWithState(step, "rule string, eval_ms long, v double, state string, transition string", "last string", "append", "NoTimeout")

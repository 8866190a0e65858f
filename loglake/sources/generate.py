"""Synthetic logs: a function of seed and row number, so any partitioning yields the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import canonical_attrs, millis_ts
from ..model import LOG_COLUMNS

#: Services, and levels in ten equally likely slots.
SERVICES = ("auth", "checkout", "session-store", "gateway", "billing", "search", "notifier")
SLOTS = ("ERROR",) * 4 + ("WARN",) * 2 + ("INFO",) * 3 + ("DEBUG",)
MESSAGES = {
    "ERROR": ("upstream call gave up after retries", "payment provider refused the request", "connection pool is exhausted", "token signature does not verify"),
    "WARN": ("slow response from a dependency", "retry scheduled with backoff", "queue is filling up"),
    "INFO": ("request served", "user signed in", "job finished", "cache warmed"),
    "DEBUG": ("cache lookup missed", "payload decoded"),
}
PODS, REGIONS = 12, ("eu-1", "us-1", "us-2")


def _draw(seed: int, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(salt)), F.lit(n)).cast("int")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def expressions(seed: int) -> dict[str, Column]:
    """All columns but the time, from a column ``id``."""
    level = _pick(SLOTS, _draw(seed, "level", len(SLOTS)))
    message = None
    for name, texts in MESSAGES.items():
        text = _pick(texts, _draw(seed, "message", len(texts)))
        message = F.when(level == name, text) if message is None else message.when(level == name, text)
    return {
        "level": level,
        "service": _pick(SERVICES, _draw(seed, "service", len(SERVICES))),
        "status": F.when(level == "ERROR", 503).otherwise(200),
        "message": F.concat(message, F.lit(" seq="), F.col("id").cast("string")),
        "trace_id": F.lower(F.hex(F.xxhash64(F.lit(seed), F.col("id"), F.lit("trace")))),
        "attrs_json": canonical_attrs(F.create_map(F.lit("pod"), F.concat(F.lit("pod-"), _draw(seed, "pod", PODS).cast("string")), F.lit("region"), _pick(REGIONS, _draw(seed, "region", len(REGIONS))))),
    }


def generate(spark: SparkSession, n: int, seed: int = 1, start_ms: int = 1_700_000_000_000) -> DataFrame:
    """n records whose times rise by 1 to 400 ms. Blocks of ids are summed apart and then shifted, so no task sees all rows."""
    block = 100_000
    rows = spark.range(n).withColumn("step", _draw(seed, "step", 400) + 1).withColumn("block", F.floor(F.col("id") / block))
    sums = rows.groupBy("block").agg(F.sum("step").alias("total"))
    before = sums.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("step").over(Window.partitionBy("block").orderBy("id"))
    rows = rows.withColumn("_in", inside).join(before, "block").withColumn("ts", millis_ts(F.lit(start_ms) + F.col("before") + F.col("_in")))
    return rows.withColumns(expressions(seed)).select(*LOG_COLUMNS)


def live(spark: SparkSession, rows_per_second: int = 10, seed: int = 1) -> DataFrame:
    """An endless stream of such records at the current time."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.col("value").alias("id")).withColumns(expressions(seed)).select(*LOG_COLUMNS)

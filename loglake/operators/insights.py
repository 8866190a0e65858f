"""Histograms, service metrics and pages about storage, cost and pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TIERS
from ..plans.cost import GIB, HOSTED_USD, STORAGE_USD, TIER_CLASS, by_tier

BARS = 60
#: Fixed values of the modelled latency: a base and milliseconds for each percent of errors.
P99_BASE_MS, P99_PER_PERCENT = 800, 18


def bucket_seconds(start_ms: int, end_ms: int) -> int:
    """Width of about ``BARS`` bars over a range, in whole seconds, at least one."""
    return max(1, (end_ms - start_ms) // BARS // 1000)


def histogram(logs: DataFrame, start_ms: int, end_ms: int, *more: Column) -> DataFrame:
    """bucket_start, total, errors and further aggregates by time, buckets counted from the epoch; empty ones are absent."""
    bars = logs.groupBy(F.window("ts", f"{bucket_seconds(start_ms, end_ms)} seconds").alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "ERROR").alias("errors"), *more)
    return bars.select(F.col("w.start").alias("bucket_start"), *[c for c in bars.columns if c != "w"]).orderBy("bucket_start")


def filled(bars: DataFrame, seconds: int) -> DataFrame:
    """The same with empty buckets as zeros between the first and the last."""
    ends = bars.agg(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL '{seconds}' SECOND"))).alias("bucket_start"))
    return every.join(bars, "bucket_start", "left").select("bucket_start", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("errors", F.lit(0)).alias("errors")).orderBy("bucket_start")


def rates(bars: DataFrame, seconds: int) -> DataFrame:
    """Ingest rate, error percent and modelled p99 of each bar. The p99 is a formula, not a measurement."""
    error = F.when(F.col("total") > 0, F.col("errors") / F.col("total") * 100).otherwise(0.0)
    return bars.select("bucket_start", (F.col("total") / seconds).alias("ingest_rate"), error.alias("error_rate"), (P99_BASE_MS + error * P99_PER_PERCENT).alias("p99_modeled"))


def volume_by_service(logs: DataFrame, stored_gib: float | None = None) -> DataFrame:
    """service, n and, given the stored size, the share of it by rows; the largest first."""
    out = logs.groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    if stored_gib is not None:
        # One row per service is left here, so the window over all of them is small.
        out = out.withColumn("gib", F.col("n") / F.sum("n").over(Window.partitionBy()) * F.lit(stored_gib))
    return out.orderBy(F.desc("n"), "service")


def tiles(bars: DataFrame, seconds: int, stored_bytes: int) -> DataFrame:
    """One row: stored GiB, mean ingest rate, error percent over all, mean modelled p99."""
    series = rates(bars, seconds)
    total = bars.agg(F.sum("total").alias("t"), F.sum("errors").alias("e"))
    means = series.agg(F.avg("ingest_rate").alias("ingest_rate"), F.avg("p99_modeled").alias("p99_modeled"))
    return means.crossJoin(total).select(F.lit(stored_bytes / GIB).alias("stored_gib"), "ingest_rate", F.when(F.col("t") > 0, F.col("e") / F.col("t") * 100).otherwise(0.0).alias("error_rate"), "p99_modeled")


def storage_page(files: DataFrame) -> DataFrame:
    """tier, bytes, objects, small and compacted files, percent of all bytes, US dollars a month."""
    sums = files.groupBy("tier").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("objects"), F.count_if(F.col("path").rlike(r"/part-[^/]*$")).alias("small_files")
    )
    share = F.when(F.sum("bytes").over(Window.partitionBy()) > 0, F.col("bytes") / F.sum("bytes").over(Window.partitionBy()) * 100).otherwise(0.0)
    usd = F.col("bytes") / GIB * by_tier(lambda c: F.lit(STORAGE_USD[c]))
    return sums.select("tier", "bytes", "objects", "small_files", (F.col("objects") - F.col("small_files")).alias("compacted_files"), share.alias("pct"), usd.alias("usd_month"))


def cost_page(files: DataFrame, days: int = 30) -> dict:
    """Storage cost a month, projected over ``days`` (1 to 3650), and an illustrative hosted price. Nothing here is invented history."""
    days = min(max(days, 1), 3650)
    rows = {r["tier"]: r for r in storage_page(files).collect()}
    month = sum(r["usd_month"] for r in rows.values())
    size = sum(r["bytes"] for r in rows.values())
    return {"month_usd": month, "projected_usd": month * days / 30, "hosted_usd_illustrative": size / GIB * HOSTED_USD, "per_tier": {t: rows[t]["usd_month"] for t in TIERS if t in rows}, "classes": dict(TIER_CLASS)}


def expensive_queries(audit: DataFrame, n: int = 5) -> DataFrame:
    return audit.orderBy(F.desc("scanned_bytes"), F.desc("ts_millis")).limit(n)


def pipelines_page(files: DataFrame, now_ms: int) -> dict:
    """Seconds since the newest record, and between files."""
    row = files.agg(F.max("max_ts").alias("b"), F.min("min_ts").alias("a"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return {"ingest_lag_s": None, "roll_cadence_s": None, "files": 0}
    return {"ingest_lag_s": max(0, now_ms - row["b"]) / 1000, "roll_cadence_s": (row["b"] - row["a"]) / 1000 / row["n"], "files": row["n"]}

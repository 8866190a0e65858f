"""Prices and latencies of storage classes, and the price of a scan before it runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TIER_CLASS, TIERS
from .dsl import Fact
from .prune import select_files

GIB = float(1 << 30)
CLASSES = ("Standard", "GlacierInstant", "GlacierFlexible", "GlacierDeepArchive")
MODES = ("expedited", "standard", "bulk")
#: US dollars for a GiB-month in each class.
STORAGE_USD = {"Standard": 0.023, "GlacierInstant": 0.004, "GlacierFlexible": 0.0036, "GlacierDeepArchive": 0.00099}
#: Milliseconds until a restored object can be read, and until the first byte of a GET.
RESTORE_MS = {"expedited": 5 * 60_000, "standard": 4 * 3_600_000, "bulk": 8 * 3_600_000}
FIRST_BYTE_MS = {"Standard": 20, "GlacierInstant": 30, "GlacierFlexible": 20, "GlacierDeepArchive": 20}
#: Illustrative price of a hosted service per GiB ingested.
HOSTED_USD = 2.50


def retrieval_usd(storage_class: str, mode: str = "standard") -> float:
    """US dollars for a GiB read from a class."""
    if storage_class == "Standard":
        return 0.0
    if storage_class == "GlacierInstant":
        return 0.03
    if storage_class == "GlacierFlexible":
        return {"bulk": 0.0, "standard": 0.01, "expedited": 0.03}[mode]
    return 0.0025 if mode == "bulk" else 0.02


def restore_ms(storage_class: str, mode: str = "standard") -> int:
    return 0 if storage_class in ("Standard", "GlacierInstant") else RESTORE_MS[mode]


def by_tier(value) -> Column:
    """A CASE over the tier column with a value for each."""
    out = None
    for tier in TIERS:
        out = F.when(F.col("tier") == tier, value(TIER_CLASS[tier])) if out is None else out.when(F.col("tier") == tier, value(TIER_CLASS[tier]))
    return out


def priced(files: DataFrame, mode: str = "standard") -> DataFrame:
    """tier, files, bytes, gib, usd, restore_ms for tiers with bytes."""
    sums = files.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).where("bytes > 0")
    return sums.select(
        "tier",
        "files",
        "bytes",
        (F.col("bytes") / GIB).alias("gib"),
        (F.col("bytes") / GIB * by_tier(lambda c: F.lit(retrieval_usd(c, mode)))).alias("usd"),
        by_tier(lambda c: F.lit(restore_ms(c, mode))).cast("long").alias("restore_ms"),
    )


def estimate_scan(manifest: DataFrame, tiers: Iterable[str] | None = None, window: tuple[int | None, int | None] | None = None, facts: Iterable[Fact] = (), bytes_per_s: float = 0.0, mode: str = "standard", chosen: DataFrame | None = None) -> dict:
    """The price of a scan: exactly the files that the scan would read, or those already chosen. Nothing but the catalog is opened."""
    chosen = select_files(manifest, tiers, window, list(facts)) if chosen is None else chosen
    rows = {r["tier"]: r for r in priced(chosen, mode).collect()}
    # At most one row per tier comes here.
    tiers_out = [rows[t].asDict() for t in TIERS if t in rows]
    total = sum(r["bytes"] for r in tiers_out)
    return {
        "bytes": total,
        "gib": total / GIB,
        "cost_usd": sum(r["usd"] for r in tiers_out),
        "restore_ms": max((r["restore_ms"] for r in tiers_out), default=0),
        "scan_ms": int(total / bytes_per_s * 1000) if bytes_per_s > 0 else 0,
        "cold_restore": any(r["restore_ms"] > 0 for r in tiers_out),
        "files_touched": chosen.count(),
        "files_total": manifest.count(),
        "per_tier": tiers_out,
    }


def one_class(total_bytes: int, storage_class: str, mode: str = "standard", mib_per_core: float = 250.0, cores: int = 4) -> dict:
    """What reading so many bytes of one class costs and takes, by the model alone."""
    gib = total_bytes / GIB
    speed = mib_per_core * cores * (1 << 20)
    return {"gib": gib, "cost_usd": gib * retrieval_usd(storage_class, mode), "restore_ms": restore_ms(storage_class, mode), "scan_ms": int(total_bytes / speed * 1000) if speed > 0 else 0}

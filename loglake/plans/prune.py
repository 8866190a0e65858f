"""Which files a query must read: one selection, shared by the scan and by its price.

Files are rows of a manifest DataFrame. A file is left out only on proof: its tier is not asked for, its time
range lies outside, a recorded set of values lacks the wanted one, or its trigrams lack one of the term's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trigrams import may_contain
from ..model import TIERS
from .dsl import Fact


def overlaps(window: tuple[int | None, int | None] | None) -> Column:
    """Inclusive overlap of a file's time range with the window; an open end does not bound."""
    if window is None:
        return F.lit(True)
    start, end = window
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("max_ts") >= start)
    return out if end is None else out & (F.col("min_ts") <= end)


def may_hold(facts: Iterable[Fact], trigrams: str | None = "trigrams") -> Column:
    """False where the statistics prove that no row satisfies the facts. An empty or null set is unknown."""
    out = F.lit(True)
    for fact in facts:
        if fact.kind == "text":
            if trigrams is not None:
                out = out & may_contain(F.col(trigrams), fact.value)
            continue
        column = F.col({"service": "services", "level": "levels"}[fact.kind])
        out = out & (column.isNull() | (F.size(column) == 0) | F.array_contains(column, fact.value))
    return out


def select_files(manifest: DataFrame, tiers: Iterable[str] | None = None, window: tuple[int | None, int | None] | None = None, facts: Iterable[Fact] = ()) -> DataFrame:
    """The files to read. No tiers means all; unknown names select nothing by themselves."""
    wanted = [t for t in (tiers or ()) if t in TIERS] or (list(TIERS) if not tiers else [])
    has_text = "trigrams" in manifest.columns
    return manifest.where(F.col("tier").isin(*wanted) if wanted else F.lit(False)).where(overlaps(window)).where(may_hold(facts, "trigrams" if has_text else None))


def select_row_groups(groups: DataFrame, files: DataFrame, facts: Iterable[Fact]) -> DataFrame:
    """path, row_group of selected files that may hold the text terms.

    ``groups`` has path, row_group, trigrams. A file whose recorded groups do not number its row groups is read whole:
    it contributes no row here, and the reader takes a path without groups as all of it.
    """
    text = [f for f in facts if f.kind == "text"]
    counts = groups.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    sound = files.join(counts, "path").where(F.col("_n") == F.col("row_groups")).select("path")
    return groups.join(sound, "path", "left_semi").where(may_hold(text)).select("path", "row_group")


def selectivity(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: row groups to scan and in total, over the indexed files."""
    total = groups.agg(F.count(F.lit(1)).alias("row_groups_total"))
    return chosen.agg(F.count(F.lit(1)).alias("row_groups_scanned")).crossJoin(total)

"""Compaction: small files of a tier become few large ones, without losing or reordering the catalog's proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LOG_SCHEMA, TIERS
from .catalog import PATHS
from .ingest import Ingestor

#: Passes that are written at once.
AT_ONCE = 6


@dataclass(frozen=True)
class Compacted:
    tier: str
    files_before: int
    files_after: int
    files_merged: int


def bins(sizes: Iterable[int], target: int) -> list[list[int]]:
    """Indices in order, a bin closing as soon as it holds ``target`` bytes; what remains is a bin too."""
    out, held, total = [], [], 0
    for k, size in enumerate(sizes):
        held.append(k)
        total += size
        if total >= target:
            out.append(held)
            held, total = [], 0
    return [*out, held] if held else out


class Compactor:
    """``ingestor`` names the table. Old files stay for readers of older versions until :meth:`vacuum`."""

    def __init__(self, ingestor: Ingestor) -> None:
        self.ingestor, self.catalog, self.config = ingestor, ingestor.catalog, ingestor.config.compaction

    def _plan(self, target: int) -> dict[str, list[list]]:
        """Multi-file bins of each tier, which hold all its small files if there is more than one: a last file that would be a bin by itself
        joins the bin before. The plan handles catalog rows of small files only, and those are bounded by the trigger."""
        rows = self.catalog.files().where(F.col("bytes") < target).select("tier", "path", "bytes", "min_ts").orderBy("tier", "min_ts", "path").collect()
        out = {}
        for tier in TIERS:
            mine = [r for r in rows if r["tier"] == tier]
            made = bins((r["bytes"] for r in mine), target)
            if len(made) > 1 and len(made[-1]) == 1:
                made[-2:] = [made[-2] + made[-1]]
            out[tier] = [[mine[k] for k in b] for b in made if len(b) > 1]
        return out

    def pending(self, target: int | None = None) -> dict[str, int]:
        """Files that a full compaction would merge, per tier."""
        return {tier: sum(map(len, made)) for tier, made in self._plan(target or self.config.target_bytes).items()}

    def compact(self, target: int | None = None, max_files: int | None = None) -> tuple[list[Compacted], bool]:
        """Merges bins until about ``max_files`` files are used (always at least one bin). Second: whether more remain."""
        plan, used, more = self._plan(target or self.config.target_bytes), 0, False
        chosen: dict[str, list[list]] = {}
        for tier, made in plan.items():
            for b in made:
                if max_files is not None and used and used + len(b) > max_files:
                    more = True
                    break
                used += len(b)
                chosen.setdefault(tier, []).append(b)
            if more:
                break
        return self._run(chosen, max_files), more

    def _run(self, plan: dict[str, list[list]], max_files: int | None = None) -> list[Compacted]:
        """Merges the plan's bins, in passes of about ``max_files`` files. Several passes are written at once, each bin by one task of its own, and committed in order."""
        counts = {r["tier"]: r["n"] for r in self.catalog.files().groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
        todo = [(tier, [r["path"] for r in b]) for tier, made in plan.items() for b in made]
        generation = self.catalog.head()["compaction_gen"]
        passes: list[list] = []
        for k, (tier, paths) in enumerate(todo):
            if not passes or max_files is None or sum(len(p) for _, p, _ in passes[-1]) + len(paths) > max_files:
                passes.append([])
            passes[-1].append((tier, paths, generation + 1 + k))
        pool = ThreadPoolExecutor(AT_ONCE)
        try:
            for taken, made in zip(passes, pool.map(lambda p: [self._written(*b) for b in p], passes), strict=True):
                for (_, paths, _), (files, grams) in zip(taken, made, strict=True):
                    self.catalog.replace(files, grams, paths)
        finally:
            pool.shutdown(cancel_futures=True)
        merged = {tier: sum(map(len, made)) for tier, made in plan.items() if made}
        return [Compacted(tier, counts.get(tier, 0), counts.get(tier, 0) - n + len(plan[tier]), n) for tier, n in merged.items()]

    def _written(self, tier: str, paths: list[str], generation: int) -> tuple[DataFrame, str]:
        """One file of these files' rows, not yet in the catalog: its manifest row, and the folder of its trigram rows."""
        spark, store = self.ingestor.store.spark, self.ingestor.store
        rows = spark.read.schema(LOG_SCHEMA).parquet(*[store.full(p) for p in paths]).withColumn("tier", F.lit(tier))
        # Named by what it merges: two compactors of the same files write the same name.
        name = hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]
        config = self.ingestor.config
        whole = replace(config, ingest=replace(config.ingest, roll_rows=0))
        return Ingestor(store, self.ingestor.table, whole).write(rows.coalesce(1).sortWithinPartitions("ts"), name, f"c{generation:06d}")

    def _merge(self, tier: str, paths: list[str]) -> None:
        self.catalog.replace(*self._written(tier, paths, self.catalog.head()["compaction_gen"] + 1), paths)

    def maybe_compact(self) -> list[Compacted]:
        """Compacts in bounded passes if a tier has enough small files. One plan is carried out whole, so no pass merges again what another made."""
        plan = self._plan(self.config.target_bytes) if self.config.enabled else {}
        if max((sum(map(len, made)) for made in plan.values()), default=0) < self.config.trigger_files:
            return []
        return self._run(plan, self.config.files_per_pass)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Deletes files that none of the newest versions has; older versions can no longer be read then."""
        known = self.catalog.versions()
        if not known:
            return []
        live = None
        for v in known[-keep_versions:]:
            part = self.catalog.files(v).select("path")
            live = part if live is None else live.union(part)
        head = self.catalog.head()
        gone = [] if not head["dropped"] else [r["path"] for r in self.catalog._read(head["dropped"], PATHS).join(live, "path", "left_anti").collect()]
        for path in gone:
            self.ingestor.store.delete(path)
        return gone


def span(files) -> tuple[int, int] | None:
    """Time range of a manifest in epoch milliseconds."""
    row = files.agg(F.min("min_ts").alias("a"), F.max("max_ts").alias("b")).first()
    return None if row["a"] is None else (row["a"], row["b"])

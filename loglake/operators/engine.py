"""Queries over a table: scan exactly the selected files, run, bound the result, encode it."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import shims
from ..model import FILE_SCHEMA, LOG_SCHEMA, TIERS, BadQuery, ResultTooLarge
from ..plans.cost import estimate_scan, priced
from ..plans.dsl import DEFAULT_LIMIT, Search, is_sql, parse
from ..plans.prune import select_files, select_row_groups
from ..sources import rowgroups
from .catalog import Catalog
from .insights import histogram



@dataclass(frozen=True)
class Selection:
    """What a query reads: paths, and for each, where known, the row groups that may match."""

    files: list[dict]
    groups: dict[str, list[int]]
    groups_total: int

    @property
    def groups_scanned(self) -> int:
        return sum(map(len, self.groups.values()))


class Engine:
    def __init__(self, catalog: Catalog, config: Config | None = None) -> None:
        self.catalog, self.config, self.spark = catalog, config or Config(), catalog.spark
        shims.register(self.spark)
        rowgroups.register(self.spark)

    # ------------------------------------------------------------ scan

    def scan(self, paths: Iterable[str]) -> DataFrame:
        """Those files and no others, with the stored schema; never a folder listing. No path: no rows."""
        full = [self.catalog.store.full(p) for p in paths]
        return self.spark.read.schema(LOG_SCHEMA).parquet(*full) if full else self.spark.createDataFrame([], LOG_SCHEMA)

    def scan_row_groups(self, selection: Selection) -> DataFrame:
        """The selected row groups only, by the Python source; for stores that executors see as files."""
        plan = [[self.catalog.store.full(f["path"]), selection.groups.get(f["path"])] for f in selection.files]
        return self.spark.read.format(rowgroups.NAME).option("plan", json.dumps(plan)).load()

    def select(self, search: Search | None, tiers: Iterable[str] | None = None) -> Selection:
        """The files for a search (all of the tiers' for raw SQL), text sets being read only if a term needs them."""
        chosen, groups = self.candidates(search, tiers)
        files = [r.asDict() for r in chosen.orderBy("path").collect()]
        if groups is None:
            return Selection([{k: f[k] for k in FILE_SCHEMA.names} for f in files], {}, 0)
        total = groups.count()
        kept = {f["path"]: f["groups"] for f in files if f["groups"] is not None}
        return Selection([{k: f[k] for k in FILE_SCHEMA.names} for f in files], kept, total)

    def candidates(self, search: Search | None, tiers: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
        """The files that a search reads and, if it has a text term, the text sets of all files that tier, time and values admit.

        With a text term a file has ``groups``, those of its row groups that may hold the term, or null where its sets are not
        recorded for each: it is read whole. A file all of whose sets lack the term is left out. Sets meet the term one
        row group at a time, after the other tests; no file's sets are merged.
        """
        facts = search.facts if search else ()
        files = select_files(self.catalog.files(), tiers, search.window if search else None, [f for f in facts if f.kind != "text"])
        if not any(f.kind == "text" for f in facts):
            return files, None
        groups = self.catalog.row_groups(of=files)
        passed = select_row_groups(groups, files.select("path", "row_groups"), facts).groupBy("path").agg(F.sort_array(F.collect_list("row_group")).alias("groups"))
        recorded = groups.groupBy("path").agg(F.count(F.lit(1)).alias("_recorded"))
        rows = files.join(recorded, "path", "left").join(passed, "path", "left")
        return rows.where(F.col("groups").isNotNull() | F.col("_recorded").isNull() | (F.col("_recorded") != F.col("row_groups"))).drop("_recorded"), groups

    # ------------------------------------------------------------ run

    def plan(self, query: str, logs: DataFrame, now_ms: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """The frame that answers a query over given rows. SQL sees them under the table's name."""
        if not is_sql(query):
            return parse(query, now_ms).apply(logs, limit)
        return self.sql(query, logs)

    def sql(self, query: str, logs: DataFrame) -> DataFrame:
        """One read-only statement. Anything else is refused before it runs."""
        body = query.strip().rstrip(";")
        if not is_sql(body) or ";" in re.sub(r"'(?:[^']|'')*'", "", body):
            raise BadQuery("one SELECT or WITH statement is expected")
        bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "", body)
        if re.match(r"\s*with\b", bare, re.IGNORECASE) and re.search(r"\)\s*(insert|update|delete|merge)\b", bare, re.IGNORECASE):
            raise BadQuery("the statement writes")
        logs.createOrReplaceTempView(self.catalog.table)
        try:
            return self.spark.sql(body)
        except (ParseException, AnalysisException) as e:
            raise BadQuery(str(e)) from e

    def query(self, query: str, now_ms: int, tiers: Iterable[str] | None = None, limit: int = DEFAULT_LIMIT) -> dict:
        """Rows, statistics and histogram, as an HTTP answer would have them.

        events counts the rows that match, events_in_files those of all selected files.
        """
        began = time.monotonic()
        search = None if is_sql(query) else parse(query, now_ms)
        picked = self.select(search, tiers)
        logs = self.scan(f["path"] for f in picked.files)
        rows = self.rows(self.plan(query, logs, now_ms, limit))
        # One pass gives bars and matches: what matches is counted beside each bar.
        match = F.count_if(search.condition()) if search else F.count(F.lit(1))
        bars = histogram(logs, *_range(picked.files), match.alias("matches")).collect() if picked.files else []
        in_files = sum(b["total"] for b in bars)
        events = sum(b["matches"] for b in bars)
        return {
            "rows": rows,
            "stats": {
                "events": events,
                "events_in_files": in_files,
                "scanned_bytes": sum(f["bytes"] for f in picked.files),
                "elapsed_ms": int((time.monotonic() - began) * 1000),
                "engine": "spark",
                "files": len(picked.files),
                # Files are read whole; what the sets rule out within them is skipped by Parquet's own statistics and blooms, if at all.
                "row_groups_scanned": sum(f["row_groups"] for f in picked.files),
                "row_groups_matching": picked.groups_scanned if picked.groups_total else sum(f["row_groups"] for f in picked.files),
                "row_groups_total": picked.groups_total,
                "cost_usd": self.cost(picked.files),
                "tier": max((f["tier"] for f in picked.files), key=TIERS.index, default=None),
            },
            "histogram": [{"bucket_start": b["bucket_start"], "total": b["total"], "errors": b["errors"]} for b in bars],
        }

    def cost(self, files: list[dict]) -> float:
        if not files:
            return 0.0
        frame = self.spark.createDataFrame([(f["tier"], f["bytes"]) for f in files], "tier string, bytes long")
        return priced(frame).agg(F.sum("usd").alias("u")).first()["u"] or 0.0

    def estimate(self, query: str, now_ms: int, tiers: Iterable[str] | None = None, mode: str = "standard") -> dict:
        """The price of :meth:`query` before it runs, by the same selection."""
        search = None if is_sql(query) else parse(query, now_ms)
        speed = self.config.query.scan_mib_per_core * (1 << 20) * self.config.query.cores
        return estimate_scan(self.catalog.files(), bytes_per_s=speed, mode=mode, chosen=self.candidates(search, tiers)[0])

    # ------------------------------------------------------------ bounded results

    def batches(self, df: DataFrame) -> Iterator[pa.RecordBatch]:
        """The result, refused rather than cut if it has more rows or bytes than configured.

        One row past the limit is asked for; rows come in short batches, each held against the bytes allowed before the next is made.
        """
        most_rows, most_bytes = self.config.query.max_result_rows, self.config.query.max_result_bytes
        rows = size = 0
        for batch in _by_partition(df.limit(most_rows + 1)):
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows > most_rows:
                raise ResultTooLarge(f"the result has more than {most_rows} rows")
            if size > most_bytes:
                raise ResultTooLarge(f"the result has more than {most_bytes} bytes")
            yield batch

    def rows(self, df: DataFrame) -> list[dict]:
        """Row objects; null values are left out."""
        return [{k: v for k, v in row.items() if v is not None} for b in self.batches(df) for row in b.to_pylist()]

    def arrow(self, df: DataFrame) -> bytes:
        """An Arrow IPC stream; no byte at all for an empty result."""
        made = [b for b in self.batches(df) if b.num_rows]
        if not made:
            return b""
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, made[0].schema) as writer:
            for b in made:
                writer.write_batch(b)
        return out.getvalue().to_pybytes()

    def pretty(self, df: DataFrame) -> str:
        made, names = self.rows(df), df.columns
        cells = [[str(r.get(n, "")) for n in names] for r in made]
        widths = [max([len(n), *(len(c[k]) for c in cells)]) for k, n in enumerate(names)]
        line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        text = lambda c: "|" + "|".join(f" {v:<{w}} " for v, w in zip(c, widths, strict=True)) + "|"
        return "\n".join([line, text(names), line, *map(text, cells), line])


BATCH_ROWS = 512


def _by_partition(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """Batches without holding the whole result: partition by partition, through the row iterator."""
    schema = df.limit(0).toArrow().schema
    held: list[dict] = []
    for row in df.toLocalIterator():
        held.append(row.asDict(recursive=True))
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _range(files: list[dict]) -> tuple[int, int]:
    return min(f["min_ts"] for f in files), max(f["max_ts"] for f in files)


def single_value(df: DataFrame) -> float:
    """The number a query measures: column v of its first row if numeric, else the first numeric column, else 0."""
    row = df.limit(1).first()
    if row is None:
        return 0.0
    values = row.asDict()
    order = (["v"] if "v" in values else []) + [c for c in df.columns if c != "v"]
    for name in order:
        if isinstance(values[name], (int, float)) and not isinstance(values[name], bool) or type(values[name]).__name__ == "Decimal":
            return float(values[name])
    return 0.0



"""The library's face: a lake of log tables over a folder or bucket."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .functions.words import host, humanize, number
from .model import BadRequest
from .operators import insights
from .operators.access import Tokens
from .operators.alerts import Alerts, Rule, post, runner
from .operators.audit import Audit
from .operators.catalog import Catalog, totals
from .operators.compact import Compacted, Compactor, span
from .operators.engine import Engine
from .operators.files import Store
from .operators.ingest import Ingestor, Report
from .operators.lifecycle import policy
from .operators.metrics import Metrics
from .plans.dsl import DEFAULT_LIMIT
from .sources import otlp, wire
from .streaming import feeds


class LogLake:
    """One table of a lake. ``clock`` gives epoch milliseconds and is the only clock there is."""

    def __init__(self, spark: SparkSession, root: str, table: str = "logs", config: Config | None = None, clock: Callable[[], int] | None = None) -> None:
        self.spark, self.table, self.config = spark, table, config or Config()
        prefix = self.config.storage.prefix.strip("/")
        self.store = Store(spark, f"{root.rstrip('/')}/{prefix}" if prefix else root)
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.catalog, self.ingestor = Catalog(self.store, table), Ingestor(self.store, table, self.config)
        self.engine, self.compactor = Engine(self.catalog, self.config), Compactor(self.ingestor)
        self.rules, self.audit, self.tokens, self.counters = Alerts(self.store, table), Audit(self.store, table), Tokens(self.store), Metrics()

    # ------------------------------------------------------------ write

    def ingest(self, logs: DataFrame) -> Report:
        return self.ingestor.ingest(logs)

    def ingest_body(self, body: str) -> dict:
        """A request of JSON lines or a JSON array; bad lines are skipped and counted, a body without records is refused."""
        if len(body.encode()) > self.config.ingest.max_body_bytes:
            raise BadRequest("the body is too large")
        logs, skipped, error = wire.parse_body(self.spark, body)
        return self._taken(logs, skipped, error)

    def ingest_otlp(self, body: str) -> dict:
        return self._taken(otlp.parse(self.spark.createDataFrame([(body,)], "value string")), 0, None)

    def _taken(self, logs: DataFrame, skipped: int, error: str | None) -> dict:
        done = self.ingestor.ingest(logs)
        if not done.ingested:
            raise BadRequest(error or "no log record in the request")
        self.counters.add("ingested_rows", done.ingested)
        return {"ingested": done.ingested, "skipped": skipped, "first_error": error, "files_written": done.files_written, "bytes_written": done.bytes_written, "deduped": done.deduped}

    def compact(self, target_bytes: int = 64 << 20, max_files: int | None = None) -> tuple[list[Compacted], bool]:
        return self.compactor.compact(target_bytes, max_files)

    # ------------------------------------------------------------ read

    def query(self, query: str, tiers: Iterable[str] | None = None, limit: int = DEFAULT_LIMIT, user: str = "anonymous") -> dict:
        now = self.clock()
        began = time.monotonic()
        out = self.engine.query(query, now, tiers, limit)
        self.counters.observe(time.monotonic() - began)
        self.counters.add("queries")
        self.audit.record(now, user, query, out["stats"]["scanned_bytes"], out["stats"]["cost_usd"], out["stats"]["tier"])
        return out

    def frame(self, query: str, tiers: Iterable[str] | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """The answer as a frame, neither bounded nor run."""
        from .plans.dsl import is_sql, parse

        now = self.clock()
        search = None if is_sql(query) else parse(query, now)
        return self.engine.plan(query, self.engine.scan(f["path"] for f in self.engine.select(search, tiers).files), now, limit)

    def estimate(self, query: str = "", tiers: Iterable[str] | None = None, mode: str = "standard") -> dict:
        return self.engine.estimate(query, self.clock(), tiers, mode)

    def tail(self, since_ms: int | None = None, query: str = "") -> DataFrame:
        start = since_ms if since_ms is not None else self.newest()
        return feeds.tail(self.spark, self.store.full(self.table), start, query, self.clock())

    # ------------------------------------------------------------ pages

    def metrics(self) -> dict:
        files = self.catalog.files()
        reach = span(files)
        if reach is None:
            return {"tiles": {}, "series": [], "volume": []}
        logs = self.engine.scan(r["path"] for r in files.select("path").collect())
        width = insights.bucket_seconds(*reach)
        bars = insights.histogram(logs, *reach)
        stored = totals(files).first()["bytes"]
        return {
            "tiles": insights.tiles(bars, width, stored).first().asDict(),
            "series": [r.asDict() for r in insights.rates(bars, width).orderBy("bucket_start").collect()],
            "volume": [r.asDict() for r in insights.volume_by_service(logs, stored / insights.GIB).collect()],
        }

    def storage(self) -> list[dict]:
        return [r.asDict() for r in insights.storage_page(self.catalog.files()).collect()]

    def cost(self, days: int = 30) -> dict:
        return {**insights.cost_page(self.catalog.files(), days), "expensive_queries": [r.asDict() for r in insights.expensive_queries(self.audit.queries()).collect()]}

    def pipelines(self) -> dict:
        return insights.pipelines_page(self.catalog.files(), self.clock())

    def settings(self) -> dict:
        out = asdict(self.config)
        out["auth"]["api_token"] = "***" if out["auth"]["api_token"] else ""
        return out

    def lifecycle(self) -> dict:
        return policy(self.table, self.config.lifecycle)

    # ------------------------------------------------------------ alerts

    def create_alert(self, rule: Rule) -> Rule:
        return self.rules.create(rule, runner(self.engine))

    def evaluate_alerts(self, notify: Callable[[dict], None] | None = post) -> list:
        """Runs the rules once; changes go to their webhooks unless told otherwise."""
        return self.rules.evaluate(runner(self.engine), self.clock(), notify)

    def alerts(self) -> list[dict]:
        """Rules and their states, with times and addresses as short words."""
        now = self.clock()
        return [
            {**asdict(r), "for": humanize(max(0, now - r.status.since_ms)) if r.status.since_ms else None, "condition": f"{r.comparator} {number(r.threshold)}", "current": number(r.status.value), "webhook": host(r.webhook) if r.webhook else None}
            for r in self.rules.rules()
        ]

    def queries(self) -> list[dict]:
        """The newest audited queries; their number is capped."""
        return [r.asDict() for r in self.audit.queries().collect()]

    def newest(self) -> int:
        """Time of the newest record in epoch milliseconds, 0 for an empty table."""
        return (span(self.catalog.files()) or (0, 0))[1]

    def health(self) -> bool:
        return self.store.probe()

"""The trail of queries: one small object per query, the newest ``CAP`` count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Store

#: Records between two prunings, so the folder holds some more than the cap.
CAP, PRUNE_EVERY = 500, 100
SCHEMA = "ts_millis long, user string, sql string, scanned_bytes long, cost_usd double, tier string"


class Audit:
    def __init__(self, store: Store, table: str) -> None:
        self.store, self.home, self._since = store, f"{table}/_audit", 0

    def record(self, ts_millis: int, user: str, sql: str, scanned_bytes: int, cost_usd: float, tier: str | None) -> None:
        row = {"ts_millis": ts_millis, "user": user, "sql": sql, "scanned_bytes": scanned_bytes, "cost_usd": cost_usd, "tier": tier}
        self.store.create(f"{self.home}/{ts_millis:015d}-{uuid.uuid4().hex}.json", json.dumps(row).encode())
        self._since += 1
        if self._since >= PRUNE_EVERY:
            self._since = 0
            self.prune()

    def prune(self) -> int:
        """Deletes records beyond the cap, the oldest first."""
        old = self.store.list(self.home)[:-CAP]
        for name, _ in old:
            self.store.delete(f"{self.home}/{name}")
        return len(old)

    def queries(self) -> DataFrame:
        """The newest records first. Damaged ones are left out."""
        spark = self.store.spark
        if not self.store.list(self.home):
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(self.store.full(self.home)).where("ts_millis IS NOT NULL").orderBy(F.desc("ts_millis")).limit(CAP)

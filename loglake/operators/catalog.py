"""The catalog: which files a table has, in versions.

Version n is one small object, created exclusively, that names the manifest parts it consists of; a part is a
Parquet folder of file rows, with the files' trigram sets beside it, or of paths taken away. A commit adds
a part, so its cost follows the change, not the table; parts are merged when there are many. The names of all batches are kept, those
of late in the version and older ones in a ledger beside it, so that a batch counts once even after its files were merged. A writer that finds its
version taken reloads and tries again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FILE_SCHEMA, Conflict, LogLakeError
from .files import Store

ATTEMPTS, MOST_PARTS = 16, 24
TRIGRAMS = T.StructType([T.StructField("path", T.StringType()), T.StructField("row_group", T.IntegerType()), T.StructField("trigrams", T.ArrayType(T.IntegerType()))])
PATHS = T.StructType([T.StructField("path", T.StringType())])
BATCHES = T.StructType([T.StructField("batch", T.StringType())])


class Catalog:
    def __init__(self, store: Store, table: str) -> None:
        self.store, self.table, self.spark = store, table, store.spark
        self.home = f"{table}/_metadata"

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self.store.list(self.home) if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def head(self, version: int | None = None) -> dict:
        """A version's document, the newest by default; a table without one is empty."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "added": [], "dropped": [], "compaction_gen": 0, "batches": [], "ledger": None}
        chosen = known[-1] if version is None else version
        data = self.store.read(f"{self.home}/v{chosen:012d}.json")
        if data is None:
            raise LogLakeError(f"{self.table} has no version {chosen}")
        try:
            return json.loads(data)
        except ValueError as e:
            raise LogLakeError(f"version {chosen} of {self.table} is damaged: {e}") from e

    def _part(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(self.store.full(f"{self.home}/{name}"))
        return name

    def _read(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.store.full(f"{self.home}/{n}") for n in names])

    def commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Applies a change to the newest version until it is the one that follows; None means nothing to do."""
        for _ in range(ATTEMPTS):
            base = self.head()
            new = change(base)
            if new is None:
                return base
            new = {**new, "version": base["version"] + 1}
            if self.store.create(f"{self.home}/v{new['version']:012d}.json", json.dumps(new).encode()):
                return new
        raise Conflict(f"{self.table}: no commit in {ATTEMPTS} attempts")

    # ------------------------------------------------------------ contents

    def files(self, version: int | None = None, trigrams: bool = False) -> DataFrame:
        """The manifest: one row per file. Trigram sets are joined only if asked for; a file without a set has null."""
        head = self.head(version)
        rows = self._read(head["added"], FILE_SCHEMA)
        if head["dropped"]:
            rows = rows.join(self._read(head["dropped"], PATHS), "path", "left_anti")
        if not trigrams:
            return rows
        sets = self._read([n.replace("files-", "grams-") for n in head["added"]], TRIGRAMS)
        per_file = sets.where("trigrams IS NOT NULL").select("path", F.explode("trigrams").alias("t")).groupBy("path").agg(F.collect_set("t").alias("trigrams"))
        return rows.join(per_file, "path", "left")

    def row_groups(self, version: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """path, row_group, trigrams of live files, or of given ones of them."""
        head = self.head(version)
        of = self.files(version) if of is None else of
        return self._read([n.replace("files-", "grams-") for n in head["added"]], TRIGRAMS).join(of.select("path"), "path", "left_semi")

    def has(self, batch: str, head: dict | None = None) -> bool:
        """Whether a batch was ever committed, whatever became of its files since."""
        head = self.head() if head is None else head
        if batch in head.get("batches", []):
            return True
        return bool(head.get("ledger")) and not self._read([head["ledger"]], BATCHES).where(F.col("batch") == batch).isEmpty()

    def _place(self, files: DataFrame, grams: str) -> str:
        """Writes file rows as a part and moves their text sets, a folder that executors wrote, beside it."""
        name = self._part(files.select(*FILE_SCHEMA.names), "files")
        self.store.move(grams, f"{self.home}/{name.replace('files-', 'grams-')}")
        return name

    def append(self, files: DataFrame, grams: str, batch: str) -> bool:
        """Adds a batch's file rows, unless a version has the batch: of several senders one adds it. Text sets are in place before
        the version that names them."""
        name = self._place(files, grams)
        done = self.commit(lambda h: None if self.has(batch, h) else {**h, "added": [*h["added"], name], "batches": [*h.get("batches", []), batch]})
        return name in done["added"]

    def replace(self, files: DataFrame, grams: str, gone: list[str]) -> dict:
        """Compaction's commit: files in, paths out, next generation. Fails unless every path is live in the version it follows."""
        name = self._place(files, grams)
        taken = self.spark.createDataFrame([(p,) for p in gone], PATHS)
        drop = self._part(taken, "drops")

        def change(h: dict) -> dict:
            live = self._read(h["added"], FILE_SCHEMA).join(taken, "path", "left_semi").select("path").distinct()
            if h["dropped"]:
                live = live.join(self._read(h["dropped"], PATHS), "path", "left_anti")
            if live.count() < len(set(gone)):
                raise Conflict(f"{self.table}: another compaction took some of these files")
            return {**h, "added": [*h["added"], name], "dropped": [*h["dropped"], drop], "compaction_gen": h["compaction_gen"] + 1}

        return self.commit(change)

    def tidy(self, most: int = MOST_PARTS) -> dict:
        """Merges the parts into one when there are many; older versions keep their parts and stay readable."""
        head = self.head()
        if len(head["added"]) <= most:
            return head
        name = f"files-{uuid.uuid4().hex}"
        self.files().write.parquet(self.store.full(f"{self.home}/{name}"))
        self.row_groups().write.parquet(self.store.full(f"{self.home}/{name.replace('files-', 'grams-')}"))
        known = self.spark.createDataFrame([(b,) for b in head.get("batches", [])], BATCHES)
        if head.get("ledger"):
            known = known.union(self._read([head["ledger"]], BATCHES))
        ledger = f"batches-{uuid.uuid4().hex}"
        known.write.parquet(self.store.full(f"{self.home}/{ledger}"))
        return self.commit(lambda h: {**h, "added": [name], "dropped": [], "batches": [], "ledger": ledger} if h["version"] == head["version"] else None)


def totals(files: DataFrame) -> DataFrame:
    """files, bytes, rows, min_ts, max_ts of a manifest."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))

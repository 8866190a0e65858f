"""Ingest: route by severity, write tiered Parquet, take statistics, publish, commit.

Data is durable before the catalog names it. The name of a file derives from the content of its batch, so a batch that
is sent again (a retried request, a replayed micro-batch) finds itself in the catalog and adds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import trigrams
from ..functions.records import approx_bytes, tier_of, ts_millis
from ..model import FILE_SCHEMA, LOG_COLUMNS, TIERS
from .catalog import TRIGRAMS, Catalog
from .files import Store

BLOOM_COLUMNS = ("trace_id", "service", "level", "message")


@dataclass(frozen=True)
class Report:
    ingested: int
    files_written: int
    bytes_written: int
    deduped: bool = False


def rows_a_file(config: Config, rows: int, size: int) -> int:
    """Records after which a file is rolled: as many as are allowed, or fewer where those would exceed the bytes allowed."""
    most, room = config.ingest.roll_rows, config.ingest.roll_bytes
    return most if not size or room <= 0 else max(1, min(most or rows, room * rows // size))


def write_options(config: Config, roll: int | None = None) -> dict[str, str]:
    out = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3", "maxRecordsPerFile": str(config.ingest.roll_rows if roll is None else roll), "parquet.block.row.count.limit": str(config.ingest.row_group_rows)}
    # A filter is as large as a row group's values need; without their number it takes 1 MiB for each column of each row group.
    for c in BLOOM_COLUMNS:
        out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(config.ingest.row_group_rows)}
    return out


def file_stats(files: DataFrame, row_group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(per file: rows, time range, services, levels, row_groups; per row group: trigram set), the first keyed by folder and
    file name, since one task gives its files of all tiers one name, the second by the number of that.

    Sets are merged before they are dealt, so a file's rows need not meet in one task. Each trigram of a group once, with map-side
    combining, then at most 37**3 per list. Until then a file goes by a number: two of one number would get sets too large, which rule out less.
    """
    rows = files.select(F.substring_index("_metadata.file_path", "/", -2).alias("name"), F.floor(F.col("_metadata.row_index") / row_group_rows).cast("int").alias("row_group"), "ts", "service", "level", "message")
    stats = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts_millis(F.col("ts"))).alias("min_ts"),
        F.max(ts_millis(F.col("ts"))).alias("max_ts"),
        F.sort_array(F.collect_set("service")).alias("services"),
        F.sort_array(F.collect_set("level")).alias("levels"),
        (F.max("row_group") + 1).cast("long").alias("row_groups"),
    )
    grams = trigrams.sets(rows.select(file_number(F.col("name")), "row_group", "message"), ["file", "row_group"], F.col("message"), short=True)
    return stats, grams.groupBy("file", "row_group").agg(F.sort_array(F.collect_list("t")).alias("trigrams"))


def file_number(name: Column) -> Column:
    return F.xxhash64(name).alias("file")


class Ingestor:
    def __init__(self, store: Store, table: str, config: Config | None = None) -> None:
        self.store, self.table, self.config, self.catalog = store, table, config or Config(), Catalog(store, table)

    def ingest(self, logs: DataFrame) -> Report:
        """Appends records; the frame must give the same rows whenever it runs."""
        logs = logs.select(*LOG_COLUMNS)
        mark = logs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*LOG_COLUMNS).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *LOG_COLUMNS)).alias("b"), F.sum(approx_bytes(F.col("message"), F.col("service"), F.col("attrs_json"))).alias("size")).first()
        if not mark["n"]:
            return Report(0, 0, 0)
        batch = f"{(int(mark['a']) ^ int(mark['n'])) & (2**64 - 1):016x}{mark['b'] & (2**64 - 1):016x}"
        if self.catalog.has(batch):
            return Report(mark["n"], 0, 0, deduped=True)
        tiered = logs.withColumn("tier", tier_of(F.col("level"), self.config.routing))
        # An hour of a tier may be most of a batch: it is dealt to as many tasks as it has files' worth of rows.
        roll = rows_a_file(self.config, mark["n"], mark["size"])
        pieces = max(1, mark["n"] // max(1, roll))
        salt = F.pmod(F.xxhash64(*LOG_COLUMNS), F.lit(pieces))
        files, grams = self.write(tiered.repartition("tier", F.floor(ts_millis(F.col("ts")) / 3_600_000), salt).sortWithinPartitions("tier", "ts"), batch, roll=roll)
        if not self.catalog.append(files, grams, batch):
            return Report(mark["n"], 0, 0, deduped=True)
        done = files.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
        self.catalog.tidy()
        return Report(mark["n"], done["n"], done["b"])

    def _name(self, tier: str, batch: str, k: int, kind: str = "part") -> str:
        return f"{self.table}/{tier}/{kind}-{batch}-{k:05d}.parquet"

    def write(self, tiered: DataFrame, batch: str, kind: str = "part", roll: int | None = None) -> tuple[DataFrame, str]:
        """Writes rows with a tier to their places; returns the manifest rows of the new files and the folder of their trigram rows,
        which executors write: only file rows pass through the driver.

        ``kind`` begins the files' names: ``part`` as ingested, ``c`` and a generation as merged.
        """
        staging = f"{self.table}/_staging/{uuid.uuid4().hex}"
        tiered.write.options(**write_options(self.config, roll)).partitionBy("tier").parquet(self.store.full(staging))
        rows, spark = [], self.store.spark
        for tier in TIERS:
            written = [(n, size) for n, size in self.store.list(f"{staging}/tier={tier}") if n.endswith(".parquet")]
            rows += [(f"tier={tier}/{n}", self._name(tier, batch, k, kind), size, tier) for k, (n, size) in enumerate(written)]
        placed = spark.createDataFrame(rows, "name string, path string, bytes long, tier string")
        read = spark.read.parquet(self.store.full(staging))
        stats, sets = file_stats(read, self.config.ingest.row_group_rows)
        # Taken before the staged files move.
        files = placed.join(stats, "name").select(*FILE_SCHEMA.names)
        files, grams = _held(spark, files), f"{staging}-grams"
        placed.withColumn("file", file_number(F.col("name"))).join(sets, "file").select(*TRIGRAMS.names).write.parquet(self.store.full(grams))
        for name, path, _, _ in rows:
            self.store.move(f"{staging}/{name}", path)
        self.store.delete(staging)
        return files, grams


def _held(spark, df: DataFrame) -> DataFrame:
    """File rows of one batch, kept on the driver: names, ranges and short lists of values."""
    return spark.createDataFrame(df.collect(), FILE_SCHEMA)

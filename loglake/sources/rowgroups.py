"""A Python data source that reads chosen row groups of Parquet files, each file's choice being one partition.

    spark.read.format("loglake_row_groups").option("plan", json.dumps([[path, [0, 3]], [path2, None]])).load()

Spark's own reader cannot be told which row groups to read. Paths must be visible to executors as files; the
default scan, which skips whole files, has no such need.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import LOG_COLUMNS, LOG_SCHEMA

NAME = "loglake_row_groups"


class _Piece(InputPartition):
    def __init__(self, path: str, groups: list[int] | None) -> None:
        self.path, self.groups = path, groups


class RowGroupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RowGroupReader(json.loads(self.options["plan"]))


class RowGroupReader(DataSourceReader):
    def __init__(self, plan: list) -> None:
        self.plan = plan

    def partitions(self) -> list[InputPartition]:
        return [_Piece(p, g) for p, g in self.plan if g is None or g]

    def read(self, partition: _Piece) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        file = pq.ParquetFile(partition.path.removeprefix("file://").removeprefix("file:"))
        groups = range(file.num_row_groups) if partition.groups is None else partition.groups
        for batch in file.iter_batches(row_groups=list(groups), columns=list(LOG_COLUMNS)):
            yield batch.set_column(0, pa.field("ts", pa.timestamp("us")), batch.column("ts").cast(pa.timestamp("us")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RowGroupSource)

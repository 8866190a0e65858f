"""Newline-delimited JSON and JSON arrays to log records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import canonical_attrs, millis_ts, normal_level
from ..model import LOG_COLUMNS, WIRE_SCHEMA, BadRequest

CORRUPT = "_corrupt"
_CHECKED = T.StructType([*WIRE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The wire fields of each non-blank line and, where a line is no valid record, the line itself in ``_corrupt``."""
    text = F.col(column)
    rows = lines.where(F.length(F.trim(text)) > 0).select(F.from_json(text, _CHECKED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), text.alias("_line"))
    rows = rows.select("r.*", "_line")
    lacks = F.col("ts_millis").isNull() | F.col("service").isNull() | F.col("message").isNull()
    return rows.withColumn(CORRUPT, F.when(lacks | F.col(CORRUPT).isNotNull(), F.col("_line"))).drop("_line")


def to_logs(wire: DataFrame) -> DataFrame:
    """Wire records in the storage schema. An absent level is INFO; attributes become sorted compact JSON."""
    return wire.select(
        millis_ts(F.col("ts_millis")).alias("ts"),
        normal_level(F.coalesce("level", F.lit("INFO"))).alias("level"),
        "service",
        F.col("status").cast("int").alias("status"),
        "message",
        "trace_id",
        canonical_attrs(F.col("attrs")).alias("attrs_json"),
    ).select(*LOG_COLUMNS)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Files of one record per line; any bad line fails the load when it runs."""
    rows = parse_lines(spark.read.text(path))
    bad = F.raise_error(F.concat(F.lit("not a log record: "), F.col(CORRUPT)))
    return to_logs(rows.withColumn("ts_millis", F.when(F.col(CORRUPT).isNotNull(), bad.cast("long")).otherwise(F.col("ts_millis"))))


def parse_body(spark: SparkSession, body: str) -> tuple[DataFrame, int, str | None]:
    """(records, lines skipped, first error) of one request, whose size its receiver bounds.

    A body that starts with ``[`` is an array and valid as a whole or not at all; else each line stands alone.
    """
    if body.lstrip().startswith("["):
        try:
            items = json.loads(body)
        except ValueError as e:
            raise BadRequest(f"invalid JSON array: {e}") from e
        lines = [(n, json.dumps(x)) for n, x in enumerate(items, 1)]
    else:
        lines = [(n, x) for n, x in enumerate(body.splitlines(), 1) if x.strip()]
    rows = parse_lines(spark.createDataFrame(lines, "n int, value string").coalesce(1)).collect()
    bad = [n for (n, _), r in zip(lines, rows, strict=True) if r[CORRUPT] is not None]
    if bad and body.lstrip().startswith("["):
        raise BadRequest(f"invalid record: element {bad[0]}")
    good = [r[:-1] for r in rows if r[CORRUPT] is None]
    return to_logs(spark.createDataFrame(good, WIRE_SCHEMA)), len(bad), f"line {bad[0]}: not a log record" if bad else None

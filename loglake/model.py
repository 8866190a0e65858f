"""The log record, its storage schema, levels, tiers and storage classes."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = ("ERROR", "WARN", "INFO", "DEBUG")
TIERS = ("hot", "warm", "cold")
#: Storage class behind each tier.
TIER_CLASS = {"hot": "Standard", "warm": "GlacierInstant", "cold": "GlacierFlexible"}

LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("attrs_json", T.StringType()),
    ]
)
LOG_COLUMNS = tuple(LOG_SCHEMA.names)

#: Record as it arrives; ts_millis, service and message are required.
WIRE_SCHEMA = T.StructType(
    [
        T.StructField("ts_millis", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("min_ts", T.LongType()),
        T.StructField("max_ts", T.LongType()),
        T.StructField("tier", T.StringType()),
        T.StructField("services", T.ArrayType(T.StringType())),
        T.StructField("levels", T.ArrayType(T.StringType())),
        T.StructField("row_groups", T.LongType()),
    ]
)


class LogLakeError(Exception):
    """Base of the engine's errors; ``status`` is what an HTTP layer would answer."""

    status = 500


class BadQuery(LogLakeError, ValueError):
    status = 400


class ResultTooLarge(LogLakeError):
    status = 413


class BadRequest(LogLakeError, ValueError):
    status = 400


class Conflict(LogLakeError):
    """The catalog moved on between read and commit, too often."""


class Forbidden(LogLakeError):
    status = 403

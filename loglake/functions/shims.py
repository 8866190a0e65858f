"""SQL functions that logs users expect and Spark lacks, as session SQL functions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments and body.
FUNCTIONS = {
    "to_timestamp_millis": ("ms BIGINT", "TIMESTAMP_NTZ", "cast(timestamp_millis(ms) AS timestamp_ntz)"),
    "date_bin": (
        "width INTERVAL DAY TO SECOND, ts TIMESTAMP_NTZ, origin TIMESTAMP_NTZ",
        "TIMESTAMP_NTZ",
        "cast(timestamp_micros(unix_micros(cast(origin AS timestamp)) + cast(floor((unix_micros(cast(ts AS timestamp)) - unix_micros(cast(origin AS timestamp))) / (extract(SECOND FROM width) * 1000000 + extract(MINUTE FROM width) * 60000000 + extract(HOUR FROM width) * 3600000000 + extract(DAY FROM width) * 86400000000)) AS BIGINT) * cast(extract(SECOND FROM width) * 1000000 + extract(MINUTE FROM width) * 60000000 + extract(HOUR FROM width) * 3600000000 + extract(DAY FROM width) * 86400000000 AS BIGINT)) AS timestamp_ntz)",
    ),
    "epoch_millis": ("ts TIMESTAMP_NTZ", "BIGINT", "unix_millis(cast(ts AS timestamp))"),
}


def register(spark: SparkSession) -> None:
    """Adds the functions to the session; sessions must run in UTC, as log times have no zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

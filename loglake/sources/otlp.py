"""OTLP/JSON log exports to log records, by nested explodes and map expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import STATUS_KEYS, canonical_attrs, millis_ts, severity_level
from ..model import LOG_COLUMNS

_S = T.StringType()
#: Numbers are read as text, since the format allows both.
VALUE = T.StructType([T.StructField(n, _S) for n in ("stringValue", "boolValue", "intValue", "doubleValue")])
ATTRS = T.ArrayType(T.StructType([T.StructField("key", _S), T.StructField("value", VALUE)]))
RECORD = T.StructType(
    [T.StructField(n, _S) for n in ("timeUnixNano", "observedTimeUnixNano", "severityNumber", "severityText")]
    + [T.StructField("body", VALUE), T.StructField("attributes", ATTRS), T.StructField("traceId", _S)]
)
REQUEST = T.StructType(
    [
        T.StructField(
            "resourceLogs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("resource", T.StructType([T.StructField("attributes", ATTRS)])),
                        T.StructField("scopeLogs", T.ArrayType(T.StructType([T.StructField("logRecords", T.ArrayType(RECORD))]))),
                    ]
                )
            ),
        )
    ]
)


def text_of(value: Column) -> Column:
    """A scalar value as text; arrays, maps and bytes have none."""
    return F.coalesce(value["stringValue"], value["boolValue"], value["intValue"], value["doubleValue"])


def attr_map(attrs: Column) -> Column:
    """Scalar attributes as a map; of equal keys the last wins."""
    pairs = F.filter(F.coalesce(attrs, F.array().cast(ATTRS)), lambda a: a["key"].isNotNull() & text_of(a["value"]).isNotNull())
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, _: k != a["key"]), F.create_map(a["key"], text_of(a["value"]))))


def merged(first: Column, second: Column) -> Column:
    """Both maps; the second wins."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)


def parse(requests: DataFrame, column: str = "value") -> DataFrame:
    """The requests' records; a malformed request fails the query when it runs."""
    rows = requests.select(F.from_json(F.col(column), REQUEST, {"mode": "FAILFAST"}).alias("r")).select(F.explode("r.resourceLogs").alias("rl"))
    rows = rows.select(attr_map(F.col("rl.resource.attributes")).alias("res"), F.explode("rl.scopeLogs").alias("sl")).select("res", F.explode("sl.logRecords").alias("x"))
    nanos = F.coalesce(F.nullif(F.col("x.timeUnixNano").try_cast("long"), F.lit(0)), F.col("x.observedTimeUnixNano").try_cast("long"), F.lit(0))
    rows = rows.select("res", "x", merged(F.col("res"), attr_map(F.col("x.attributes"))).alias("attrs"), nanos.alias("ns")).withColumn("ms", F.expr("ns DIV 1000000"))
    status = F.coalesce(*[F.try_element_at("attrs", F.lit(k)).try_cast("double").cast("int") for k in STATUS_KEYS])
    return rows.select(
        millis_ts(F.col("ms")).alias("ts"),
        severity_level(F.col("x.severityText"), F.col("x.severityNumber").try_cast("int")).alias("level"),
        F.coalesce(F.try_element_at("res", F.lit("service.name")), F.lit("")).alias("service"),
        status.alias("status"),
        F.coalesce(text_of(F.col("x.body")), F.lit("")).alias("message"),
        F.nullif(F.col("x.traceId"), F.lit("")).alias("trace_id"),
        canonical_attrs(F.col("attrs")).alias("attrs_json"),
    ).select(*LOG_COLUMNS)

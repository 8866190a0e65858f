"""The test tables as logs: ``events`` become log records, ``documents`` a corpus to search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import SERVICES

#: Templates by level; a row takes the one at event_id modulo their number.
TEMPLATES = {
    "ERROR": ("timeout while writing to replica", "invalid token in header of request", "payment refused after third attempt"),
    "WARN": ("query ran for longer than planned", "second attempt to reach inventory"),
    "DEBUG": ("session absent from cache", "frame decoded"),
    "INFO": ("request completed", "user signed in", "heartbeat", "index loaded"),
}
#: Clock of queries that look back over these tables: 2024-01-31T00:00:00Z.
NOW_MS = 1_706_659_200_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven columns, plus tier and event_id."""
    e = load(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "click", "DEBUG").otherwise("INFO")
    e = e.withColumn("level", level)
    message = None
    for name, texts in TEMPLATES.items():
        text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod("event_id", F.lit(len(texts))) + 1).cast("int"))
        message = F.when(F.col("level") == name, text) if message is None else message.when(F.col("level") == name, text)
    return e.select(
        F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"),
        "level",
        F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (F.pmod("user_id", F.lit(len(SERVICES))) + 1).cast("int")).alias("service"),
        F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", None).otherwise(200).cast("int").alias("status"),
        F.concat(message, F.lit(" seq="), F.col("event_id").cast("string")).alias("message"),
        F.when(F.pmod("event_id", F.lit(10)) == 0, None).otherwise(F.concat(F.lit("t"), F.lpad(F.col("event_id").cast("string"), 8, "0"))).alias("trace_id"),
        F.concat(F.lit('{"k":"'), F.regexp_extract("props", "([0-9]+)", 1), F.lit('","user":"'), F.col("user_id").cast("string"), F.lit('"}')).alias("attrs_json"),
        F.when(F.col("level") == "ERROR", "hot").when(F.col("level") == "DEBUG", "cold").otherwise("warm").alias("tier"),
        "event_id",
    )


def _case(name: str, values: tuple[str, ...], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def logs_cte() -> str:
    """The same mapping for the SQL counterparts: a common table ``logs``."""
    message = "CASE level " + " ".join(f"WHEN '{n}' THEN {_case(n, t, 'event_id')}" for n, t in TEMPLATES.items()) + " END"
    return f"""WITH leveled AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level FROM events),
logs AS (
  SELECT CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, level, {_case('service', SERVICES, 'user_id')} AS service,
    CAST(CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN NULL ELSE 200 END AS INTEGER) AS status,
    {message} || ' seq=' || CAST(event_id AS VARCHAR) AS message,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE 't' || lpad(CAST(event_id AS VARCHAR), 8, '0') END AS trace_id,
    '{{"k":"' || regexp_extract(props, '([0-9]+)', 1) || '","user":"' || CAST(user_id AS VARCHAR) || '"}}' AS attrs_json,
    CASE level WHEN 'ERROR' THEN 'hot' WHEN 'DEBUG' THEN 'cold' ELSE 'warm' END AS tier, event_id
  FROM leveled)
"""


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("n_chars") < 500, "ERROR").when(F.col("n_chars") < 2000, "WARN").when(F.col("n_chars") < 8000, "INFO").otherwise("DEBUG").alias("level"),
        F.col("source").alias("service"),
        F.lit(None).cast("int").alias("status"),
        F.col("text").alias("message"),
        F.lit(None).cast("string").alias("trace_id"),
        F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}')).alias("attrs_json"),
        F.col("doc_id"),
    )

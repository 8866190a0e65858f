"""Routing, file statistics, pruning, prices and record decoding, on files modelled from ``logs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import normal_level, severity_level, tier_of, ts_millis
from ..functions.trigrams import ALPHABET, may_contain, sets
from ..operators import insights
from ..operators.catalog import totals
from ..plans.cost import priced
from ..plans.dsl import Fact
from ..plans.prune import select_files
from ..sources import otlp
from ..sources.tables import document_logs, event_logs, load, logs_cte
from .search import Query

QUERIES: dict[str, Query] = {}

#: A modelled file: the logs of a tier and a span of time, at so many bytes a row.
SPAN_MS, ROW_BYTES = 36 * 3_600_000, 120


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = event_logs(spark, sf_dir).withColumn("_ms", ts_millis(F.col("ts")))
    part = F.floor(F.col("_ms") / SPAN_MS).cast("long")
    files = logs.groupBy("tier", part.alias("part")).agg(
        F.count("*").alias("rows"), F.min("_ms").alias("min_ts"), F.max("_ms").alias("max_ts"), F.sort_array(F.collect_set("service")).alias("services"), F.sort_array(F.collect_set("level")).alias("levels")
    )
    return files.select(F.concat("tier", F.lit("/part-"), F.col("part").cast("string")).alias("path"), (F.col("rows") * ROW_BYTES).alias("bytes"), "rows", "min_ts", "max_ts", "tier", "services", "levels", F.lit(1).cast("long").alias("row_groups"))


_FILES = f""", files AS (SELECT tier || '/part-' || CAST(CAST(epoch_us(ts) // 1000 // {SPAN_MS} AS BIGINT) AS VARCHAR) AS path, count(*) * {ROW_BYTES} AS bytes, count(*) AS rows,
  CAST(min(epoch_us(ts) // 1000) AS BIGINT) AS min_ts, CAST(max(epoch_us(ts) // 1000) AS BIGINT) AS max_ts, tier, list_sort(list(DISTINCT service)) AS services, list_sort(list(DISTINCT level)) AS levels
  FROM logs GROUP BY tier, path)"""


def _on_files(name: str, run, sql: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(modelled(spark, sf_dir)), f"{logs_cte()}{_FILES} {sql}")


_DAY = 1_705_276_800_000  # 2024-01-15
QUERIES["tier_route_counts"] = (
    lambda spark, sf_dir: event_logs(spark, sf_dir).withColumn("tier", tier_of(F.col("level"))).groupBy("tier", "level").agg(F.count("*").alias("n")),
    f"{logs_cte()} SELECT tier, level, count(*) AS n FROM logs GROUP BY tier, level",
)
_on_files("file_stats", lambda f: f.select("path", "bytes", "rows", "min_ts", "max_ts", F.array_join("services", ",").alias("services"), F.array_join("levels", ",").alias("levels")), "SELECT path, bytes, rows, min_ts, max_ts, array_to_string(services, ',') AS services, array_to_string(levels, ',') AS levels FROM files")
_on_files("manifest_totals", totals, "SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(rows) AS BIGINT) AS rows, min(min_ts) AS min_ts, max(max_ts) AS max_ts FROM files")
_on_files("select_files_tier", lambda f: select_files(f, ["hot", "nonsense"]).select("path"), "SELECT path FROM files WHERE tier = 'hot'")
_on_files("select_files_window", lambda f: select_files(f, None, (_DAY, _DAY + 86_400_000)).select("path"), f"SELECT path FROM files WHERE max_ts >= {_DAY} AND min_ts <= {_DAY + 86_400_000}")
_on_files("select_files_level", lambda f: select_files(f, None, None, [Fact("level", "WARN")]).select("path"), "SELECT path FROM files WHERE list_contains(levels, 'WARN')")
_on_files("select_files_service", lambda f: select_files(f, ["warm"], None, [Fact("service", "auth"), Fact("service", "billing")]).select("path"), "SELECT path FROM files WHERE tier = 'warm' AND list_contains(services, 'auth') AND list_contains(services, 'billing')")
_on_files("estimate_per_tier", lambda f: priced(select_files(f, None, (_DAY, None))).select("tier", "files", "bytes", F.round("usd", 12).alias("usd"), "restore_ms"), f"SELECT tier, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / 1073741824.0 * CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 0.03 ELSE 0.01 END, 12) AS usd, CAST(CASE tier WHEN 'cold' THEN 14400000 ELSE 0 END AS BIGINT) AS restore_ms FROM files WHERE max_ts >= {_DAY} GROUP BY tier")
_on_files("storage_page", lambda f: insights.storage_page(f).select("tier", "bytes", "objects", "small_files", "compacted_files", F.round("pct", 9).alias("pct"), F.round("usd_month", 12).alias("usd_month")), "SELECT tier, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS objects, count(*) AS small_files, CAST(0 AS BIGINT) AS compacted_files, round(sum(bytes) / sum(sum(bytes)) OVER () * 100.0, 9) AS pct, round(sum(bytes) / 1073741824.0 * CASE tier WHEN 'hot' THEN 0.023 WHEN 'warm' THEN 0.004 ELSE 0.0036 END, 12) AS usd_month FROM files GROUP BY tier")
_on_files("cost_projection", lambda f: insights.storage_page(f).agg(F.round(F.sum("usd_month"), 12).alias("month"), F.round(F.sum("usd_month") * 90 / 30, 12).alias("projected")), "SELECT round(sum(usd), 12) AS month, round(sum(usd) * 3, 12) AS projected FROM (SELECT bytes / 1073741824.0 * CASE tier WHEN 'hot' THEN 0.023 WHEN 'warm' THEN 0.004 ELSE 0.0036 END AS usd FROM files)")
_on_files("pipelines_lag", lambda f: f.agg(((F.lit(1_706_659_200_000) - F.max("max_ts")) / 1000).alias("lag_s"), F.round((F.max("max_ts") - F.min("min_ts")) / 1000 / F.count("*"), 6).alias("cadence_s")), "SELECT (1706659200000 - max(max_ts)) / 1000 AS lag_s, round((max(max_ts) - min(min_ts)) / 1000 / count(*), 6) AS cadence_s FROM files")

# ---------------------------------------------------------------- text

_CODES = f"list_transform(string_split(regexp_replace(lower(message), '[^a-z0-9]', '_', 'g'), ''), lambda c: instr('{ALPHABET}', c) - 1)"


def _sets(spark: SparkSession, sf_dir: str, term: str | None = None) -> DataFrame:
    logs = event_logs(spark, sf_dir).withColumn("part", F.floor(ts_millis(F.col("ts")) / SPAN_MS).cast("long"))
    return sets(logs, ["tier", "part"], F.col("message"), term=term)


QUERIES["trigram_file_sets"] = (
    lambda spark, sf_dir: _sets(spark, sf_dir).groupBy("tier", "part").agg(F.count("*").alias("n"), F.sum("t").alias("total")),
    f"""{logs_cte()}, c AS (SELECT tier, CAST(epoch_us(ts) // 1000 // {SPAN_MS} AS BIGINT) AS part, {_CODES} AS codes FROM logs),
    g AS (SELECT DISTINCT tier, part, codes[i] * 1369 + codes[i + 1] * 37 + codes[i + 2] AS t FROM (SELECT tier, part, codes, unnest(range(1, len(codes) - 1)) AS i FROM c))
    SELECT tier, part, count(*) AS n, CAST(sum(t) AS BIGINT) AS total FROM g GROUP BY tier, part""",
)


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text search that reads only the modelled files whose trigrams admit the term."""
    term = "inventory"
    logs = event_logs(spark, sf_dir).withColumn("part", F.floor(ts_millis(F.col("ts")) / SPAN_MS).cast("long"))
    found = _sets(spark, sf_dir, term).groupBy("tier", "part").agg(F.collect_set("t").alias("trigrams"))
    return logs.join(found.where(may_contain(F.col("trigrams"), term)), ["tier", "part"], "left_semi").where(F.col("message").ilike(f"%{term}%")).select("event_id", "message")


QUERIES["trigram_prune_equals_scan"] = (_pruned, f"{logs_cte()} SELECT event_id, message FROM logs WHERE message ILIKE '%inventory%'")
QUERIES["grep_documents"] = (
    lambda spark, sf_dir: document_logs(spark, sf_dir).where(F.col("message").ilike("%apache license%")).select("doc_id", "service", "level"),
    "SELECT doc_id, source AS service, CASE WHEN n_chars < 500 THEN 'ERROR' WHEN n_chars < 2000 THEN 'WARN' WHEN n_chars < 8000 THEN 'INFO' ELSE 'DEBUG' END AS level FROM documents WHERE text ILIKE '%apache license%'",
)

# ---------------------------------------------------------------- records

_WORDS = ("Error", " FATAL ", "warning", "WARN", "trace", "Debug", "notice", "nonsense", "err", "")
QUERIES["wire_level_normalize"] = (
    lambda spark, sf_dir: load(spark, sf_dir, "events").select("event_id", normal_level(F.element_at(F.array(*map(F.lit, _WORDS)), (F.pmod("event_id", F.lit(len(_WORDS))) + 1).cast("int"))).alias("level")),
    "SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'WARN' WHEN 4 THEN 'DEBUG' WHEN 5 THEN 'DEBUG' WHEN 8 THEN 'ERROR' ELSE 'INFO' END AS level FROM events",
)
QUERIES["otlp_level_map"] = (
    lambda spark, sf_dir: load(spark, sf_dir, "events").select("event_id", severity_level(F.when(F.pmod("event_id", F.lit(3)) == 0, "Warning"), F.pmod("event_id", F.lit(25)).cast("int")).alias("level")),
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'WARN' WHEN event_id % 25 BETWEEN 1 AND 8 THEN 'DEBUG' WHEN event_id % 25 BETWEEN 9 AND 12 THEN 'INFO' WHEN event_id % 25 BETWEEN 13 AND 16 THEN 'WARN' WHEN event_id % 25 >= 17 THEN 'ERROR' ELSE 'INFO' END AS level FROM events",
)


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as OTLP requests, decoded again."""
    e = load(spark, sf_dir, "events")
    body = F.format_string(
        '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc%d"}},{"key":"zone","value":{"stringValue":"a"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"%d","severityNumber":%d,"body":{"stringValue":"%s"},"attributes":[{"key":"status","value":{"intValue":"%d"}},{"key":"zone","value":{"boolValue":true}},{"key":"list","value":{"arrayValue":{}}}],"traceId":""}]}]}]}',
        F.pmod("user_id", F.lit(5)), F.unix_micros(F.col("ts").cast("timestamp")) * 1000, F.pmod("event_id", F.lit(24)), "event_type", F.pmod("event_id", F.lit(500)),
    )
    return otlp.parse(e.select(body.alias("value")))


QUERIES["otlp_flatten"] = (
    _exports,
    """SELECT CAST(make_timestamp(epoch_us(ts) // 1000 * 1000) AS TIMESTAMP) AS ts,
    CASE WHEN event_id % 24 BETWEEN 1 AND 8 THEN 'DEBUG' WHEN event_id % 24 BETWEEN 9 AND 12 THEN 'INFO' WHEN event_id % 24 BETWEEN 13 AND 16 THEN 'WARN' WHEN event_id % 24 >= 17 THEN 'ERROR' ELSE 'INFO' END AS level,
    'svc' || CAST(user_id % 5 AS VARCHAR) AS service, CAST(event_id % 500 AS INTEGER) AS status, event_type AS message, CAST(NULL AS VARCHAR) AS trace_id,
    '{"service.name":"svc' || CAST(user_id % 5 AS VARCHAR) || '","status":"' || CAST(event_id % 500 AS VARCHAR) || '","zone":"true"}' AS attrs_json FROM events""",
)
QUERIES["attrs_as_map"] = (
    lambda spark, sf_dir: event_logs(spark, sf_dir).select("event_id", F.from_json("attrs_json", "map<string,string>").alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["user"].alias("user_key"), F.get_json_object(F.to_json("m"), "$.k").alias("again")),
    f"""{logs_cte()} SELECT event_id, attrs_json ->> '$.k' AS k, attrs_json ->> '$.user' AS user_key, attrs_json ->> '$.k' AS again FROM logs""",
)

"""Searches, histograms, metrics and alerts over ``logs``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import ts_millis
from ..operators import insights
from ..operators.alerts import transitions
from ..plans.dsl import parse
from ..sources.tables import NOW_MS, event_logs, logs_cte
from ..streaming.feeds import tail_page

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]
QUERIES: dict[str, Query] = {}
COLUMNS = "ts, level, service, status, message, trace_id, attrs_json"


def _search(name: str, query: str, where: str) -> None:
    """A search without its limit, against a WHERE clause written by hand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse(query, NOW_MS).apply(event_logs(spark, sf_dir), None)

    QUERIES[name] = (run, f"{logs_cte()} SELECT {COLUMNS} FROM logs WHERE {where}")


def _sql(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(event_logs(spark, sf_dir)), f"{logs_cte()} {sql}")


_search("dsl_service_status", "service:auth status >= 500", "service = 'auth' AND status >= 500")
_search("dsl_level_eq", "level:error", "level = 'ERROR'")
_search("dsl_level_ne", "level!=info status!=503", "level <> 'INFO' AND status <> 503")
_search("dsl_level_range", "level>=info", "level >= 'INFO'")
_search("dsl_free_text", "TIMEOUT", "message ILIKE '%timeout%'")
_search("dsl_two_words", "auth java", "message ILIKE '%auth%' AND message ILIKE '%java%'")
_search("dsl_like_wildcard", "c_che%miss", "message ILIKE '%c_che%miss%'")
_search("dsl_attr", "k:69", """attrs_json LIKE '%"k":"69"%'""")
_search("dsl_trace_id", "trace_id:t00000042", "trace_id = 't00000042'")
_search("dsl_status_null", "status<400", "status < 400")
_search("dsl_service_range", "service>=checkout service<gateway", "service >= 'checkout' AND service < 'gateway'")
# Messages end in a number of their own; without it some are equal.
QUERIES["dsl_message_equals"] = (
    lambda spark, sf_dir: parse("message:heartbeat", NOW_MS).apply(event_logs(spark, sf_dir).withColumn("message", F.regexp_replace("message", " seq=.*", "")), None),
    f"{logs_cte()} SELECT * FROM (SELECT ts, level, service, status, regexp_replace(message, ' seq=.*', '') AS message, trace_id, attrs_json FROM logs) WHERE message = 'heartbeat'",
)
_search("dsl_last_window", "level=error | last 7d", "level = 'ERROR' AND ts >= TIMESTAMP '2024-01-24 00:00:00'")
_search("dsl_two_lasts", "service:billing | last 20d | last 36h", "service = 'billing' AND ts >= TIMESTAMP '2024-01-29 12:00:00'")
_search("dsl_everything", "", "TRUE")

# Ties on ts make a limited search ambiguous; the rank of a time is not.
QUERIES["dsl_default_limit"] = (
    lambda spark, sf_dir: parse("", NOW_MS).apply(event_logs(spark, sf_dir)).select("ts"),
    f"{logs_cte()} SELECT ts FROM logs ORDER BY ts DESC LIMIT 200",
)

_sql("agg_count_by_service", lambda d: d.groupBy("service").agg(F.count("*").alias("n")), "SELECT service, count(*) AS n FROM logs GROUP BY service")
_sql("agg_volume_by_service", lambda d: insights.volume_by_service(d, 2.0).select("service", "n", F.round("gib", 9).alias("gib")), "SELECT service, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 2.0, 9) AS gib FROM logs GROUP BY service")
_sql("agg_filter_errors", lambda d: d.agg(F.count("*").alias("total"), F.count_if(F.col("level") == "ERROR").alias("errors")), "SELECT count(*) AS total, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM logs")
_sql("agg_distinct_service", lambda d: d.agg(F.countDistinct("service").alias("n"), F.countDistinct("trace_id").alias("traces")), "SELECT count(DISTINCT service) AS n, count(DISTINCT trace_id) AS traces FROM logs")
_sql("agg_having", lambda d: d.groupBy("service", "level").agg(F.count("*").alias("n")).where("n > 100"), "SELECT service, level, count(*) AS n FROM logs GROUP BY service, level HAVING count(*) > 100")
_sql("agg_rollup_tier_level", lambda d: d.rollup("tier", "level").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g")), "SELECT tier, level, count(*) AS n, CAST(grouping(tier, level) AS BIGINT) AS g FROM logs GROUP BY ROLLUP (tier, level)")
_sql("agg_cube", lambda d: d.cube("service", "level").agg(F.count("*").alias("n"), F.max("status").alias("top")), "SELECT service, level, count(*) AS n, max(status) AS top FROM logs GROUP BY CUBE (service, level)")
_sql("agg_statistics", lambda d: d.groupBy("service").agg(F.min("status").alias("lo"), F.max("status").alias("hi"), F.round(F.avg("status"), 6).alias("mean"), F.round(F.stddev("status"), 6).alias("sd"), F.bool_or(F.col("level") == "ERROR").alias("any_error")), "SELECT service, min(status) AS lo, max(status) AS hi, round(avg(status), 6) AS mean, round(stddev(status), 6) AS sd, bool_or(level = 'ERROR') AS any_error FROM logs GROUP BY service")

_SECONDS = 43_199
_BARS = f"SELECT time_bucket(INTERVAL '{_SECONDS} seconds', ts, TIMESTAMP '1970-01-01') AS bucket_start, count(*) AS total, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM logs GROUP BY 1"


def _bars(logs: DataFrame) -> DataFrame:
    return insights.histogram(logs, 0, (_SECONDS * 1000 + 500) * insights.BARS)


_sql("hist_time_bucket", _bars, _BARS)
_sql("hist_gap_filled", lambda d: insights.filled(_bars(d.where("level = 'ERROR' AND service = 'auth' AND status = 503")), _SECONDS), f", b AS ({_BARS.replace('FROM logs', "FROM logs WHERE level = 'ERROR' AND service = 'auth' AND status = 503")}) SELECT s.t AS bucket_start, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors FROM (SELECT unnest(generate_series((SELECT min(bucket_start) FROM b), (SELECT max(bucket_start) FROM b), INTERVAL '{_SECONDS} seconds')) AS t) s LEFT JOIN b ON s.t = b.bucket_start")
_sql("metrics_rates", lambda d: insights.rates(_bars(d), _SECONDS).select("bucket_start", F.round("ingest_rate", 9).alias("ingest_rate"), F.round("error_rate", 6).alias("error_rate"), F.round("p99_modeled", 5).alias("p99_modeled")), f", b AS ({_BARS}) SELECT bucket_start, round(total / {_SECONDS}.0, 9) AS ingest_rate, round(errors / total * 100.0, 6) AS error_rate, round(800 + errors / total * 100.0 * 18, 5) AS p99_modeled FROM b")
_sql("metrics_tiles", lambda d: insights.tiles(_bars(d), _SECONDS, 3 << 30).select("stored_gib", *[F.round(c, 6).alias(c) for c in ("ingest_rate", "error_rate", "p99_modeled")]), f", b AS ({_BARS}) SELECT CAST(3.0 AS DOUBLE) AS stored_gib, round(avg(total / {_SECONDS}.0), 6) AS ingest_rate, round(sum(errors) / sum(total) * 100.0, 6) AS error_rate, round(avg(800 + errors / total * 100.0 * 18), 6) AS p99_modeled FROM b")

_sql("alert_error_volume", lambda d: d.where("level = 'ERROR'").agg(F.count("*").alias("v")), "SELECT count(*) AS v FROM logs WHERE level = 'ERROR'")
_sql("alert_auth_5xx", lambda d: d.where("service = 'auth' AND status >= 500").agg(F.count("*").alias("v")), "SELECT count(*) AS v FROM logs WHERE service = 'auth' AND status >= 500")


def _evaluations(logs: DataFrame) -> DataFrame:
    day = F.floor(ts_millis(F.col("ts")) / 86_400_000).cast("long")
    return logs.groupBy(F.col("service").alias("rule"), day.alias("eval_ms")).agg(F.count_if(F.col("level") == "ERROR").cast("double").alias("v"))


_sql(
    "alert_transitions",
    lambda d: transitions(_evaluations(d), "gt", 10),
    """, e AS (SELECT service AS rule, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS eval_ms, CAST(count(*) FILTER (WHERE level = 'ERROR') AS DOUBLE) AS v FROM logs GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN v > 10 THEN 'firing' ELSE 'ok' END AS state FROM e),
    p AS (SELECT *, lag(state, 1, 'ok') OVER (PARTITION BY rule ORDER BY eval_ms) AS was FROM s)
    SELECT rule, eval_ms, v, state, CASE WHEN state = was THEN 'unchanged' WHEN state = 'firing' THEN 'fired' ELSE 'resolved' END AS transition FROM p""",
)
_sql("tail_since", lambda d: tail_page(d, NOW_MS - 5 * 86_400_000, 100).select("ts_millis"), "SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_millis FROM logs WHERE ts > TIMESTAMP '2024-01-26 00:00:00' ORDER BY ts LIMIT 100")

"""What surrounds a search: decoding, generation, prices, access, rules, result encodings, streams, each as a query."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Ingest
from ..functions import shims
from ..functions.records import approx_bytes, ts_millis
from ..functions.trigrams import decode, encode, sets
from ..functions.words import host, humanize, number
from ..operators import access, alerts, audit, insights, lifecycle
from ..operators.compact import bins
from ..operators.engine import single_value
from ..operators.ingest import rows_a_file
from ..operators.metrics import BOUNDS, Metrics
from ..operators.simstore import NotThawed, SimStore
from ..plans import cost
from ..plans.dsl import is_sql, parse
from ..sources import generate, otlp, wire
from ..sources.tables import NOW_MS, event_logs, logs_cte
from ..streaming import feeds
from .lake import filled, folder
from .search import COLUMNS, Query

QUERIES: dict[str, Query] = {}

# ---------------------------------------------------------------- sources


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs as records on the wire, one JSON object a line."""
    logs = event_logs(spark, sf_dir)
    attrs = F.from_json("attrs_json", "map<string,string>")
    return logs.select(F.to_json(F.struct(ts_millis(F.col("ts")).alias("ts_millis"), F.lower("level").alias("level"), "service", "status", "message", "trace_id", attrs.alias("attrs"))).alias("value"))


def _ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{folder(spark)}/ndjson"
    _lines(spark, sf_dir).write.text(place)
    return wire.read_ndjson(spark, place)


QUERIES["ndjson_read"] = (_ndjson, f"{logs_cte()} SELECT {COLUMNS} FROM logs")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = '{"ts_millis": 1706659200000, "service": "auth", "message": "m", "level": "Err", "attrs": {"b": "2", "a": "1"}}'
    cases = {"lines": f"{good}\nnot json\n\n{good}", "array": f"[{good}, {good}, {good}]", "lacks a field": f'{good}\n{{"service": "x"}}'}
    out = []
    for name, body in cases.items():
        logs, skipped, error = wire.parse_body(spark, body)
        row = logs.agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("level"), F.min("attrs_json").alias("attrs")).first()
        out.append((name, row["n"], skipped, error, row["level"], row["attrs"]))
    return spark.createDataFrame(out, "body string, n long, skipped long, first_error string, level string, attrs string")


QUERIES["body_records"] = (
    _bodies,
    """SELECT body, CAST(n AS BIGINT) AS n, CAST(skipped AS BIGINT) AS skipped, first_error, 'ERROR' AS level, '{"a":"1","b":"2"}' AS attrs
    FROM (VALUES ('lines', 2, 1, 'line 2: not a log record'), ('array', 3, 0, NULL), ('lacks a field', 1, 1, 'line 2: not a log record')) AS v(body, n, skipped, first_error)""",
)


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTLP attributes of every kind, on the resource and on the record, and times of both fields."""
    kinds = {"s": {"stringValue": "x"}, "i": {"intValue": "7"}, "b": {"boolValue": False}, "n": {"intValue": 9}, "a": {"arrayValue": {}}}
    attributes = [{"key": k, "value": v} for k, v in kinds.items()]
    records = [{"timeUnixNano": "1706659200123456789", "severityText": "warning", "body": {"stringValue": "one"}, "attributes": attributes}, {"observedTimeUnixNano": "1706659201000000000", "severityNumber": 17, "body": {"intValue": "5"}, "traceId": "abc"}]
    body = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "auth"}}]}, "scopeLogs": [{"logRecords": records}]}]}
    return otlp.parse(spark.createDataFrame([(json.dumps(body),)], "value string")).select(ts_millis(F.col("ts")).alias("ms"), "level", "service", "message", "trace_id", "attrs_json")


QUERIES["otlp_kinds"] = (
    _kinds,
    """SELECT ms, level, 'auth' AS service, message, trace_id, attrs_json FROM (VALUES
    (1706659200123, 'WARN', 'one', NULL, '{"b":"false","i":"7","n":"9","s":"x","service.name":"auth"}'), (1706659201000, 'ERROR', '5', 'abc', '{"service.name":"auth"}')) AS v(ms, level, message, trace_id, attrs_json)""",
)


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of 250,000 generated records: levels in their shares, rising times, one message a record, same rows again."""
    n, rows = 250_000, generate.generate(spark, 250_000, 7)
    again = generate.generate(spark, 250_000, 7).repartition(5)
    mark = lambda d: d.agg(F.bit_xor(F.xxhash64(*d.columns)).alias("m")).first()["m"]
    same = mark(rows) == mark(again)
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ts").alias("times"), F.countDistinct(F.regexp_extract("message", "seq=([0-9]+)", 1)).alias("messages"),
        *[(F.abs(F.count_if(F.col("level") == name) / n - generate.SLOTS.count(name) / len(generate.SLOTS)) < 0.01).alias(name.lower()) for name in dict.fromkeys(generate.SLOTS)],
    )
    return seen.withColumn("same", F.lit(same)).drop("times").withColumn("spread", F.lit(rows.agg((F.max("ts") > F.min("ts")).alias("x")).first()["x"]))


QUERIES["generated_records"] = (_generated, "SELECT CAST(250000 AS BIGINT) AS n, CAST(250000 AS BIGINT) AS messages, TRUE AS error, TRUE AS warn, TRUE AS info, TRUE AS debug, TRUE AS same, TRUE AS spread")


def _by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text search through the row-group source, reading the row groups that the text sets admit."""
    lake = filled(spark, sf_dir)
    search = parse("inventory service:billing", NOW_MS)
    return search.apply(lake.engine.scan_row_groups(lake.engine.select(search)), None)


QUERIES["row_group_search"] = (_by_groups, f"{logs_cte()} SELECT {COLUMNS} FROM logs WHERE service = 'billing' AND message ILIKE '%inventory%'")


def _group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an absent term leaves out row groups, and a frequent one keeps some."""
    config = replace(Config(), ingest=Ingest(roll_rows=20_000, row_group_rows=500))
    from ..api import LogLake

    lake = LogLake(spark, folder(spark), config=config, clock=lambda: NOW_MS)
    lake.ingest(event_logs(spark, sf_dir))
    picked = lake.engine.select(parse("zeppelin", NOW_MS))
    found = lake.engine.select(parse("heartbeat", NOW_MS))
    return spark.createDataFrame([(picked.groups_scanned < picked.groups_total, 0 < found.groups_scanned <= found.groups_total)], "rare_skips boolean, common_stays boolean")


QUERIES["row_group_selection"] = (_group_counts, "SELECT TRUE AS rare_skips, TRUE AS common_stays")

# ---------------------------------------------------------------- language and functions

_TEXTS = ("SELECT 1", "  with x as (select 1) select * from x", "selected items", "status>=500 | last 1h", "level:error", "")
QUERIES["query_kind"] = (
    lambda spark, sf_dir: spark.createDataFrame([(k, is_sql(t)) for k, t in enumerate(_TEXTS)], "k long, sql boolean"),
    "SELECT CAST(k AS BIGINT) AS k, k < 2 AS sql FROM range(6) AS r(k)",
)
QUERIES["grep_quote"] = (
    lambda spark, sf_dir: event_logs(spark, sf_dir).withColumn("message", F.replace("message", F.lit(" seq="), F.lit("'s seq="))).where(parse("heartbeat's", NOW_MS).condition()).select("event_id"),
    f"{logs_cte()} SELECT event_id FROM logs WHERE replace(message, ' seq=', chr(39) || 's seq=') ILIKE '%heartbeat_s%'",
)
_BAD = ("status>=many", "a | last 5x", "a | frob 3", "status=5x", "level:error | last 1h")


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for k, text in enumerate(_BAD):
        try:
            parse(text, NOW_MS)
            out.append((k, True))
        except ValueError:
            out.append((k, False))
    return spark.createDataFrame(out, "k long, accepted boolean")


QUERIES["query_refused"] = (_refused, "SELECT CAST(k AS BIGINT) AS k, k = 4 AS accepted FROM range(5) AS r(k)")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that read are answered, all others are refused before they run."""
    lake = filled(spark, sf_dir, 1)
    out = []
    for text in ("SELECT count(*) AS n FROM logs", "DELETE FROM logs", "SELECT 1; DROP TABLE logs", "WITH x AS (SELECT 1) INSERT INTO logs SELECT * FROM x", "SELECT no_such_column FROM logs"):
        try:
            lake.engine.sql(text, event_logs(spark, sf_dir))
            out.append((text, True))
        except ValueError:
            out.append((text, False))
    return spark.createDataFrame(out, "statement string, accepted boolean")


QUERIES["statements_refused"] = (
    _statements,
    "SELECT s AS statement, s = 'SELECT count(*) AS n FROM logs' AS accepted FROM (VALUES ('SELECT count(*) AS n FROM logs'), ('DELETE FROM logs'), ('SELECT 1; DROP TABLE logs'), ('WITH x AS (SELECT 1) INSERT INTO logs SELECT * FROM x'), ('SELECT no_such_column FROM logs')) AS v(s)",
)


def _shims(spark: SparkSession, sf_dir: str) -> DataFrame:
    shims.register(spark)
    return event_logs(spark, sf_dir).select("event_id", F.expr("to_timestamp_millis(epoch_millis(ts))").alias("ts"), F.expr("epoch_millis(ts)").alias("ms"))


QUERIES["shim_millis"] = (_shims, f"{logs_cte()} SELECT event_id, ts, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM logs")
QUERIES["record_bytes"] = (
    lambda spark, sf_dir: event_logs(spark, sf_dir).groupBy("service").agg(F.sum(approx_bytes(F.col("message"), F.col("service"), F.col("attrs_json"))).alias("bytes")),
    f"{logs_cte()} SELECT service, CAST(sum(strlen(message) + strlen(service) + coalesce(strlen(attrs_json), 0) + 64) AS BIGINT) AS bytes FROM logs GROUP BY service",
)
QUERIES["short_words"] = (
    lambda spark, sf_dir: spark.createDataFrame([(ms, humanize(ms), number(ms / 8000), host(f"https://h{ms}.example:9/a/b")) for ms in (0, 59_999, 60_000, 3_599_999, 3_600_000, 86_399_999, 86_400_000, 500_000_000)], "ms long, span string, eighth string, host string"),
    """SELECT CAST(ms AS BIGINT) AS ms, CASE WHEN ms < 60000 THEN (ms // 1000) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm' WHEN ms < 86400000 THEN (ms // 3600000) || 'h' ELSE (ms // 86400000) || 'd' END AS span,
    CASE WHEN ms % 8000 = 0 THEN CAST(ms // 8000 AS VARCHAR) ELSE printf('%.2f', ms / 8000.0) END AS eighth, 'h' || ms || '.example:9' AS host
    FROM (VALUES (0), (59999), (60000), (3599999), (3600000), (86399999), (86400000), (500000000)) AS v(ms)""",
)
QUERIES["json_attributes"] = (
    lambda spark, sf_dir: event_logs(spark, sf_dir).select("event_id", F.get_json_object("attrs_json", "$.user").alias("user_key"), F.array_join(F.array_sort(F.json_object_keys("attrs_json")), ",").alias("names")),
    f"{logs_cte()} SELECT event_id, attrs_json ->> '$.user' AS user_key, array_to_string(list_sort(json_keys(attrs_json)), ',') AS names FROM logs",
)
QUERIES["attr_rows"] = (
    lambda spark, sf_dir: event_logs(spark, sf_dir).select("event_id", F.explode(F.from_json("attrs_json", "map<string,string>"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("kinds")),
    f"{logs_cte()} SELECT k AS key, count(*) AS n, count(DISTINCT attrs_json ->> ('$.' || k)) AS kinds FROM (SELECT attrs_json, unnest(json_keys(attrs_json)) AS k FROM logs) GROUP BY k",
)


def _quantile(rows: DataFrame, key: str, value: str, share: float, width: int = 4096) -> DataFrame:
    """The exact ``share`` quantile of whole numbers by key, between two values in proportion, as percentile() has it. Ranks are counted
    by spans of values, and only the span or two that hold the place are looked into; no task holds a key's values."""
    span = F.floor(F.col(value) / width)
    sizes = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = sizes.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_key").orderBy("_span"))).withColumn("_place", (F.sum("_n").over(Window.partitionBy("_key")) - 1) * F.lit(share))
    chosen = ranked.where((F.col("_upto") - F.col("_n") <= F.ceil("_place")) & (F.col("_upto") > F.floor("_place"))).withColumn("_before", F.col("_upto") - F.col("_n"))
    inside = rows.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("_key")) & (span == F.col("_span"))).groupBy("_key", "_span", "_before", "_place", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_key", "_span").orderBy("_v")))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank(F.col("_place")), F.col("_v")))
    ends = inside.groupBy(F.col("_key").alias(key), "_place").agg(at(F.floor).alias("_low"), at(F.ceil).alias("_high"))
    return ends.select(key, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_place") - F.floor("_place"))).alias("quantile"))


def _approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates are held to a tolerance, in both engines by the exact figure. Each is counted by itself: beside a distinct count an
    estimate's sketch would be kept for every distinct value."""
    logs = event_logs(spark, sf_dir).select("service", "event_id")
    rows = logs.groupBy("service").agg(F.approx_count_distinct("event_id", 0.02).alias("kinds"), F.percentile_approx("event_id", 0.9, 10_000).alias("p90"), F.max("event_id").alias("top"))
    kinds = logs.groupBy("service").agg(F.countDistinct("event_id").alias("exactly"))
    for more in (kinds, _quantile(logs, "service", "event_id", 0.9)):
        more = more.withColumnRenamed("service", "_of")
        rows = rows.join(more, F.col("service").eqNullSafe(F.col("_of")), "left").drop("_of")
    return rows.select("service", (F.abs(F.col("kinds") / F.col("exactly") - 1) < 0.1).alias("distinct_near"), (F.abs(F.col("p90") - F.col("quantile")) <= F.col("top") * 0.05 + 50).alias("p90_near"))


QUERIES["agg_approximate"] = (
    _approximate,
    f"{logs_cte()} SELECT service, TRUE AS distinct_near, TRUE AS p90_near FROM logs GROUP BY service",
)


def _codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text sets of each service through their compact form and back, sparse and dense."""
    found = sets(event_logs(spark, sf_dir), ["service"], F.col("message")).groupBy("service").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rows = [(r["service"], len(back := decode(encode(r["t"]))), sum(back)) for r in found.toLocalIterator()]
    wide = list(range(0, 50_653, 2))
    return spark.createDataFrame([*rows, ("dense", len(decode(encode(wide))), sum(decode(encode(wide))))], "service string, n long, total long")


_CODES = "list_transform(string_split(regexp_replace(lower(message), '[^a-z0-9]', '_', 'g'), ''), lambda c: instr('abcdefghijklmnopqrstuvwxyz0123456789_', c) - 1)"
QUERIES["trigram_codec"] = (
    _codec,
    f"""{logs_cte()}, c AS (SELECT service, {_CODES} AS codes FROM logs),
    g AS (SELECT DISTINCT service, codes[i] * 1369 + codes[i + 1] * 37 + codes[i + 2] AS t FROM (SELECT service, codes, unnest(range(1, len(codes) - 1)) AS i FROM c))
    SELECT service, count(*) AS n, CAST(sum(t) AS BIGINT) AS total FROM g GROUP BY service UNION ALL SELECT 'dense', count(*), CAST(sum(2 * i) AS BIGINT) FROM range(25327) AS r(i)""",
)

# ---------------------------------------------------------------- prices


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for c in cost.CLASSES:
        for m in cost.MODES:
            one = cost.one_class(10 << 30, c, m, 250.0, 4)
            out.append((c, m, round(one["cost_usd"], 9), one["restore_ms"], one["scan_ms"], cost.FIRST_BYTE_MS[c], cost.STORAGE_USD[c]))
    return spark.createDataFrame(out, "storage_class string, mode string, usd double, restore_ms long, scan_ms long, first_byte_ms long, month_usd double")


QUERIES["price_classes"] = (
    _prices,
    """SELECT c AS storage_class, m AS mode, CAST(CASE c WHEN 'Standard' THEN 0 WHEN 'GlacierInstant' THEN 0.3 WHEN 'GlacierFlexible' THEN CASE m WHEN 'bulk' THEN 0 WHEN 'standard' THEN 0.1 ELSE 0.3 END ELSE CASE m WHEN 'bulk' THEN 0.025 ELSE 0.2 END END AS DOUBLE) AS usd,
    CAST(CASE WHEN c IN ('Standard', 'GlacierInstant') THEN 0 WHEN m = 'expedited' THEN 300000 WHEN m = 'standard' THEN 14400000 ELSE 28800000 END AS BIGINT) AS restore_ms,
    CAST(10240 AS BIGINT) AS scan_ms, CAST(CASE c WHEN 'GlacierInstant' THEN 30 ELSE 20 END AS BIGINT) AS first_byte_ms,
    CAST(CASE c WHEN 'Standard' THEN 0.023 WHEN 'GlacierInstant' THEN 0.004 WHEN 'GlacierFlexible' THEN 0.0036 ELSE 0.00099 END AS DOUBLE) AS month_usd
    FROM (VALUES ('Standard'), ('GlacierInstant'), ('GlacierFlexible'), ('GlacierDeepArchive')) AS a(c), (VALUES ('expedited'), ('standard'), ('bulk')) AS b(m)""",
)


def _thawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading one GiB of each class takes and costs in the simulated store, restored first where it must be."""
    out = []
    for c in cost.CLASSES:
        store = SimStore()
        store.put("x", 1 << 30, c)
        frozen = False
        try:
            took = store.get("x")
        except NotThawed:
            frozen = True
            store.advance(store.restore("x"))
            took = store.get("x")
        out.append((c, frozen, took, round(store.usd, 9), store.bytes_read))
    return spark.createDataFrame(out, "storage_class string, frozen boolean, took_ms long, usd double, bytes_read long")


QUERIES["simulated_reads"] = (
    _thawed,
    """SELECT c AS storage_class, archived AS frozen, CAST(first + 4096 AS BIGINT) AS took_ms, CAST(usd AS DOUBLE) AS usd, CAST(1073741824 AS BIGINT) AS bytes_read
    FROM (VALUES ('Standard', FALSE, 20, 0), ('GlacierInstant', FALSE, 30, 0.03), ('GlacierFlexible', TRUE, 20, 0.01), ('GlacierDeepArchive', TRUE, 20, 0.02)) AS v(c, archived, first, usd)""",
)
QUERIES["lifecycle_classes"] = (
    lambda spark, sf_dir: spark.createDataFrame([(d, lifecycle.class_at_age(d)) for d in range(420)], "days long, storage_class string"),
    "SELECT CAST(d AS BIGINT) AS days, CASE WHEN d >= 400 THEN NULL WHEN d >= 30 THEN 'GlacierFlexible' WHEN d >= 3 THEN 'GlacierInstant' ELSE 'Standard' END AS storage_class FROM range(420) AS r(d)",
)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lifecycle.policy("logs")["Rules"][0]
    steps = [(t["StorageClass"], t["Days"]) for t in rule["Transitions"]] + [("expired", rule["Expiration"]["Days"])]
    return spark.createDataFrame([(rule["Filter"]["Prefix"], *s) for s in steps], "prefix string, step string, days long")


QUERIES["lifecycle_rules"] = (_rules, "SELECT 'logs/' AS prefix, step, CAST(days AS BIGINT) AS days FROM (VALUES ('GLACIER_IR', 3), ('GLACIER', 30), ('expired', 400)) AS v(step, days)")

# ---------------------------------------------------------------- files


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a compaction, held against the catalog before and after."""
    lake = filled(spark, sf_dir, 3)
    count = lambda: {r["tier"]: r["count"] for r in lake.catalog.files().groupBy("tier").count().collect()}
    before, pending = count(), lake.compactor.pending()
    done = {r.tier: r for r in lake.compactor.maybe_compact()}
    after = count()
    rows = [(t, pending[t] == before[t], done[t].files_before == before[t], done[t].files_after == after[t], done[t].files_merged == pending[t]) for t in before]
    return spark.createDataFrame(rows, "tier string, all_pending boolean, before_right boolean, after_right boolean, merged_right boolean")


QUERIES["compaction_report"] = (_reports, f"{logs_cte()} SELECT DISTINCT tier, TRUE AS all_pending, TRUE AS before_right, TRUE AS after_right, TRUE AS merged_right FROM logs")
QUERIES["bin_sizes"] = (
    lambda spark, sf_dir: spark.createDataFrame([(k, len(b), sum(4 + n % 3 for n in b)) for k, b in enumerate(bins([4 + n % 3 for n in range(1000)], 100))], "bin long, files long, bytes long"),
    # Sizes 4, 5, 6 repeat, so 20 files always hold 99 to 101 bytes; the 20th closes a bin at 100 or more, else the 21st does.
    """WITH RECURSIVE f(n, bin, files, total) AS (SELECT 0, 0, 1, 4 UNION ALL
      SELECT n + 1, CASE WHEN total >= 100 THEN bin + 1 ELSE bin END, CASE WHEN total >= 100 THEN 1 ELSE files + 1 END, CASE WHEN total >= 100 THEN 0 ELSE total END + 4 + (n + 1) % 3 FROM f WHERE n < 999)
    SELECT CAST(bin AS BIGINT) AS bin, CAST(max(files) AS BIGINT) AS files, CAST(max(total) AS BIGINT) AS bytes FROM f GROUP BY bin""",
)
QUERIES["roll_limits"] = (
    lambda spark, sf_dir: spark.createDataFrame([(n, rows_a_file(Config(), 1_000_000, n)) for n in (0, 10**8, 10**9, 10**10, 10**12)], "bytes long, most_rows long"),
    "SELECT CAST(b AS BIGINT) AS bytes, CAST(CASE WHEN b = 0 THEN 100000 ELSE least(100000, 134217728 * 1000000::HUGEINT // b) END AS BIGINT) AS most_rows FROM (VALUES (0), (100000000), (1000000000), (10000000000), (1000000000000)) AS v(b)",
)
QUERIES["store_probe"] = (lambda spark, sf_dir: spark.createDataFrame([(filled(spark, sf_dir, 1).health(),)], "writable boolean"), "SELECT TRUE AS writable")

# ---------------------------------------------------------------- results


def _row_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row objects of an answer; null values are left out of them."""
    lake = filled(spark, sf_dir)
    rows = lake.engine.rows(lake.frame("SELECT level, max(status) AS top, count(*) AS n FROM logs GROUP BY level"))
    return spark.createDataFrame([(r["level"], r.get("top"), r["n"], "top" in r) for r in rows], "level string, top int, n long, has_top boolean")


QUERIES["row_objects"] = (_row_objects, f"{logs_cte()} SELECT level, max(status) AS top, count(*) AS n, max(status) IS NOT NULL AS has_top FROM logs GROUP BY level")


def _answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of an answer: matching events, events read, and the histogram's sums, all of one selection."""
    out = filled(spark, sf_dir).query("service:auth level:error", limit=5)
    bars = out["histogram"]
    row = (len(out["rows"]), out["stats"]["events"], out["stats"]["events_in_files"], sum(b["total"] for b in bars), sum(b["errors"] for b in bars), out["stats"]["tier"])
    return spark.createDataFrame([row], "shown long, events long, events_in_files long, bar_total long, bar_errors long, tier string")


QUERIES["answer_statistics"] = (
    _answer,
    f"""{logs_cte()} SELECT least(5, count(*) FILTER (WHERE service = 'auth')) AS shown, count(*) FILTER (WHERE service = 'auth') AS events, count(*) AS events_in_files, count(*) AS bar_total, count(*) AS bar_errors, 'hot' AS tier
    FROM logs WHERE level = 'ERROR'""",
)


def _sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent events of a page of records, read back, and the comment of an empty one."""
    logs = event_logs(spark, sf_dir).where("level = 'ERROR'").select("event_id", "service")
    sent = [json.loads(e.removeprefix("data: ")) for e in feeds.events(logs)]
    idle = [e.startswith(":") for e in feeds.events(logs.where("event_id < 0"))] == [True]
    return spark.createDataFrame([(r["event_id"], r["service"], idle) for r in sent], "event_id long, service string, idle boolean")


QUERIES["event_lines"] = (_sse, f"{logs_cte()} SELECT event_id, service, TRUE AS idle FROM logs WHERE level = 'ERROR'")


def _prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Metrics()
    for k in range(200):
        m.observe(k / 16)
    found = [line.split('le="')[1].split('"} ') for line in m.text().splitlines() if "_bucket" in line]
    return spark.createDataFrame([(float("inf") if b == "+Inf" else float(b), int(n)) for b, n in found], "bound double, n long")


QUERIES["latency_buckets"] = (
    _prometheus,
    f"SELECT b AS bound, count(*) FILTER (WHERE k / 16.0 <= b) AS n FROM (SELECT unnest([{', '.join(map(str, BOUNDS))}, 'Infinity'::DOUBLE]::DOUBLE[]) AS b), range(200) AS r(k) GROUP BY b",
)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five queries that read most; ties go to the later one."""
    trail = event_logs(spark, sf_dir).select(F.col("event_id").alias("ts_millis"), (F.col("event_id") % 97 * 1000).alias("scanned_bytes"))
    return insights.expensive_queries(trail)


QUERIES["expensive_queries"] = (_audited, "SELECT event_id AS ts_millis, event_id % 97 * 1000 AS scanned_bytes FROM events ORDER BY 2 DESC, 1 DESC LIMIT 5")


def _trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trail with more records than it may hold, and one that is damaged."""
    lake = filled(spark, sf_dir, 1)
    for k in range(audit.CAP + 20):
        lake.audit.record(k, "ann", f"q{k}", k, 0.5, "hot")
    lake.store.write(f"{lake.audit.home}/999999999999999-x.json", b"{not json")
    return lake.audit.queries()


QUERIES["audit_trail"] = (
    _trail,
    "SELECT k AS ts_millis, 'ann' AS user, 'q' || k AS sql, k AS scanned_bytes, CAST(0.5 AS DOUBLE) AS cost_usd, 'hot' AS tier FROM range(20, 520) AS r(k)",
)

# ---------------------------------------------------------------- access and rules


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r, o, access.allows(r, o)) for r in access.ROLES for o in ("query", "tail", "ingest", "create_alert", "audit", "issue_token")], "role string, operation string, allowed boolean")


QUERIES["role_matrix"] = (
    _roles,
    "SELECT role, operation, rank >= need AS allowed FROM (VALUES ('readonly', 0), ('readwrite', 1), ('admin', 2)) AS a(role, rank), (VALUES ('query', 0), ('tail', 0), ('ingest', 1), ('create_alert', 1), ('audit', 2), ('issue_token', 2)) AS b(operation, need)",
)
QUERIES["secret_hashes"] = (
    lambda spark, sf_dir: spark.createDataFrame([(s, access.digest(s)) for s in generate.SERVICES], "secret string, hash string"),
    f"SELECT s AS secret, sha256(s) AS hash FROM (VALUES {', '.join(f"('{s}')" for s in generate.SERVICES)}) AS v(s)",
)


def _token_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token before and after it is revoked; what is stored of it."""
    tokens = filled(spark, sf_dir, 1).tokens
    token, secret = tokens.issue("ann", "readwrite", 5)
    first = tokens.role_of(secret)
    tokens.revoke(token.id)
    stored = json.dumps([asdict(t) for t in tokens.list()])
    return spark.createDataFrame([(first, tokens.role_of(secret), secret in stored, access.digest(secret) in stored)], "before string, after string, secret_stored boolean, hash_stored boolean")


QUERIES["token_life"] = (_token_life, "SELECT 'readwrite' AS before, CAST(NULL AS VARCHAR) AS after, FALSE AS secret_stored, TRUE AS hash_stored")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(ts_millis(F.col("ts")) / 86_400_000).cast("long")
    return event_logs(spark, sf_dir).groupBy(F.col("service").alias("rule"), day.alias("eval_ms")).agg(F.count_if(F.col("level") == "ERROR").cast("double").alias("v"))


def _comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparator over the same evaluations."""
    series, out = _daily(spark, sf_dir), None
    for name in alerts.COMPARE:
        part = alerts.transitions(series, name, 10).withColumn("comparator", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("comparator", "state", "transition").agg(F.count(F.lit(1)).alias("n"))


_EVALUATED = "e AS (SELECT service AS rule, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS eval_ms, CAST(count(*) FILTER (WHERE level = 'ERROR') AS DOUBLE) AS v FROM logs GROUP BY 1, 2)"
QUERIES["alert_comparators"] = (
    _comparators,
    f"""{logs_cte()}, {_EVALUATED},
    s AS (SELECT c AS comparator, rule, eval_ms, CASE WHEN CASE c WHEN 'gt' THEN v > 10 WHEN 'ge' THEN v >= 10 WHEN 'lt' THEN v < 10 ELSE v <= 10 END THEN 'firing' ELSE 'ok' END AS state FROM e, (VALUES ('gt'), ('ge'), ('lt'), ('le')) AS k(c)),
    p AS (SELECT *, lag(state, 1, 'ok') OVER (PARTITION BY comparator, rule ORDER BY eval_ms) AS was FROM s)
    SELECT comparator, state, CASE WHEN state = was THEN 'unchanged' WHEN state = 'firing' THEN 'fired' ELSE 'resolved' END AS transition, count(*) AS n FROM p GROUP BY ALL""",
)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over a lake: one fires, one stays quiet, one cannot run and keeps its state, one is disabled; then seeds."""
    lake, told = filled(spark, sf_dir), []
    count = "SELECT count(*) AS v FROM logs WHERE level = 'ERROR'"
    for rule in (alerts.Rule("fires", count, "gt", 0.0), alerts.Rule("quiet", count, "lt", 0.0), alerts.Rule("off", count, "gt", 0.0, enabled=False)):
        lake.create_alert(rule)
    lake.rules._change(lambda rules: [*rules, alerts.Rule("broken", "SELECT nope FROM logs", "gt", 0.0)])
    lake.evaluate_alerts(told.append)
    seeded = len(lake.rules.seed("logs"))
    return spark.createDataFrame([(r.name, r.status.state, r.status.value, r.name in {t["alert"] for t in told}, seeded) for r in lake.rules.rules()], "rule string, state string, v double, told boolean, seeded long")


QUERIES["alert_evaluation"] = (
    _evaluated,
    f"""{logs_cte()}, c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM logs WHERE level = 'ERROR')
    SELECT r AS rule, CASE r WHEN 'fires' THEN 'firing' ELSE 'ok' END AS state, CASE WHEN r IN ('fires', 'quiet') THEN n ELSE 0 END AS v, r = 'fires' AS told, CAST(0 AS BIGINT) AS seeded FROM c, (VALUES ('fires'), ('quiet'), ('off'), ('broken')) AS k(r)""",
)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that a rule takes from a result: v, else the first number, else nothing."""
    texts = {"v": "SELECT 1 AS a, 2.5D AS v", "first": "SELECT 'x' AS a, 7L AS b, 8 AS c", "decimal": "SELECT 1.25BD AS v", "text v": "SELECT 'x' AS v, 3 AS b", "none": "SELECT 'x' AS a", "null": "SELECT CAST(NULL AS INT) AS v", "no row": "SELECT 1 AS v WHERE false"}
    return spark.createDataFrame([(k, single_value(spark.sql(t))) for k, t in texts.items()], "kind string, v double")


QUERIES["measured_value"] = (_measured, "SELECT kind, CAST(v AS DOUBLE) AS v FROM (VALUES ('v', 2.5), ('first', 7), ('decimal', 1.25), ('text v', 3), ('none', 0), ('null', 0), ('no row', 0)) AS t(kind, v)")

# ---------------------------------------------------------------- streams


def _drained(rows: DataFrame, mode: str) -> DataFrame:
    name = f"drained_{uuid.uuid4().hex}"
    rows.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.table(name)


def _as_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    place = f"{folder(spark)}/stream"
    rows.write.parquet(place)
    return spark.readStream.schema(rows.schema).parquet(place)


QUERIES["stream_windows"] = (
    lambda spark, sf_dir: _drained(feeds.windowed(_as_stream(spark, event_logs(spark, sf_dir).select("ts", "level")), "1 day", "40 days"), "complete"),
    f"{logs_cte()} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket_start, count(*) AS total, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM logs GROUP BY 1",
)
QUERIES["stream_alert_states"] = (
    lambda spark, sf_dir: _drained(feeds.alert_states(_as_stream(spark, _daily(spark, sf_dir)), 10), "append"),
    f"""{logs_cte()}, {_EVALUATED}, s AS (SELECT *, CASE WHEN v > 10 THEN 'firing' ELSE 'ok' END AS state FROM e),
    p AS (SELECT *, lag(state, 1, 'ok') OVER (PARTITION BY rule ORDER BY eval_ms) AS was FROM s)
    SELECT rule, eval_ms, v, state, CASE WHEN state = was THEN 'unchanged' WHEN state = 'firing' THEN 'fired' ELSE 'resolved' END AS transition FROM p""",
)


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing folder is ingested as a stream in several batches; a line that is no record is skipped and counted."""
    from ..api import LogLake

    home = folder(spark)
    _lines(spark, sf_dir).union(spark.createDataFrame([("no record",)], "value string")).repartition(6).write.text(f"{home}/landing")
    lake = LogLake(spark, f"{home}/lake", clock=lambda: NOW_MS)
    reports: list[dict] = []
    feeds.ingest_stream(lake.ingestor, f"{home}/landing", f"{home}/state", report=reports.append).awaitTermination()
    rows = lake.frame("SELECT service, level, count(*) AS n FROM logs GROUP BY service, level")
    return rows.withColumn("skipped", F.lit(sum(r["skipped"] for r in reports)).cast("long"))


QUERIES["stream_ingest"] = (_landed, f"{logs_cte()} SELECT service, level, count(*) AS n, CAST(1 AS BIGINT) AS skipped FROM logs GROUP BY service, level")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the live generator, as a stream declares them."""
    rows = generate.live(spark, 5)
    return spark.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, f in enumerate(rows.schema)], "k long, name string, type string")


QUERIES["live_columns"] = (
    _live,
    "SELECT CAST(k AS BIGINT) AS k, name, type FROM (VALUES (0, 'ts', 'timestamp_ntz'), (1, 'level', 'string'), (2, 'service', 'string'), (3, 'status', 'int'), (4, 'message', 'string'), (5, 'trace_id', 'string'), (6, 'attrs_json', 'string')) AS v(k, name, type)",
)

"""The SQL surface over ``logs`` and the retail tables: joins, subqueries, windows, set operations, functions.

Each query is one SQL text that both engines run, with the few spellings that differ given for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import shims
from ..sources.tables import event_logs, load, logs_cte
from .search import Query

QUERIES: dict[str, Query] = {}
#: What Spark runs, by name.
SPARK_SQL: dict[str, str] = {}
#: Days of a timestamp: windows over all of a service's time are cut by them, so that no task sorts more than a day.
_DAY = "epoch_millis(ts) DIV 86400000"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _both(name: str, sql: str, spark_sql: str | None = None, logs: bool = True) -> None:
    """Registers a query; ``spark_sql`` where the spelling differs."""
    text = SPARK_SQL[name] = spark_sql or sql

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shims.register(spark)
        if logs:
            event_logs(spark, sf_dir).createOrReplaceTempView("logs")
        for t in TABLES:
            if t in text:
                load(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    body = sql
    if logs:
        body = logs_cte() + (", " + sql[5:] if sql.startswith("WITH ") else sql)
    QUERIES[name] = (run, body)


# ---------------------------------------------------------------- joins

_both("join_self_trace", "SELECT a.event_id, b.event_id AS other FROM logs a JOIN logs b ON a.trace_id = b.trace_id AND a.service = b.service WHERE a.level = 'ERROR'")
_both("join_left", "SELECT a.event_id, b.status AS same_status FROM logs a LEFT JOIN logs b ON a.event_id = b.event_id AND b.level = 'ERROR' WHERE a.service = 'auth'")
_both("join_right_full", "SELECT coalesce(a.service, b.service) AS service, a.n AS errors, b.n AS warnings FROM (SELECT service, count(*) AS n FROM logs WHERE level = 'ERROR' AND service < 'm' GROUP BY service) a FULL JOIN (SELECT service, count(*) AS n FROM logs WHERE level = 'WARN' AND service > 'c' GROUP BY service) b ON a.service = b.service")
_both("join_cross", "SELECT a.service, b.level FROM (SELECT DISTINCT service FROM logs) a CROSS JOIN (SELECT DISTINCT level FROM logs) b")
_both("join_using", "SELECT service, a.n, b.top FROM (SELECT service, count(*) AS n FROM logs GROUP BY service) a JOIN (SELECT service, max(status) AS top FROM logs GROUP BY service) b USING (service)")
_both("join_semi", "SELECT event_id FROM logs a WHERE level = 'DEBUG' AND EXISTS (SELECT 1 FROM logs b WHERE b.service = a.service AND b.level = 'ERROR' AND b.status = 503)")
_both("join_anti", "SELECT event_id FROM logs a WHERE NOT EXISTS (SELECT 1 FROM logs b WHERE b.trace_id = a.trace_id)")
_both("join_in_not_in", "SELECT event_id FROM logs WHERE service IN (SELECT service FROM logs WHERE level = 'ERROR' AND status >= 500) AND NOT EXISTS (SELECT 1 FROM logs e WHERE e.level = 'ERROR' AND e.event_id = logs.event_id)")
# A range join by buckets of its width: each side meets its own and the next bucket only.
_both(
    "join_range",
    "SELECT a.event_id, b.event_id AS near FROM logs a JOIN logs b ON b.ts > a.ts AND b.ts <= a.ts + INTERVAL '60 seconds' AND a.service = b.service WHERE a.level = 'ERROR' AND b.level = 'WARN'",
    """WITH a AS (SELECT event_id, ts, service, explode(array(m, m + 1)) AS m FROM (SELECT *, epoch_millis(ts) DIV 60000 AS m FROM logs WHERE level = 'ERROR')),
    b AS (SELECT event_id, ts, service, epoch_millis(ts) DIV 60000 AS m FROM logs WHERE level = 'WARN')
    SELECT a.event_id, b.event_id AS near FROM a JOIN b ON a.service = b.service AND a.m = b.m WHERE b.ts > a.ts AND b.ts <= a.ts + INTERVAL '60' SECOND""",
)
_both(
    "join_asof",
    "SELECT event_id, (SELECT max(b.ts) FROM logs b WHERE b.service = a.service AND b.level = 'ERROR' AND b.ts < a.ts) AS last_error FROM logs a WHERE a.level = 'WARN'",
    # By days: a row looks back within its own day, and to what the days before carry over, one row each.
    f"""WITH x AS (SELECT *, {_DAY} AS d FROM logs WHERE level IN ('ERROR', 'WARN')),
    c AS (SELECT service, d, max(top) OVER (PARTITION BY service ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM (SELECT service, d, max(CASE WHEN level = 'ERROR' THEN ts END) AS top FROM x GROUP BY service, d)),
    w AS (SELECT event_id, level, service, d, max(CASE WHEN level = 'ERROR' THEN ts END) OVER (PARTITION BY service, d ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '0.001' SECOND PRECEDING) AS here FROM x)
    SELECT event_id, coalesce(here, carried) AS last_error FROM w JOIN c USING (service, d) WHERE level = 'WARN'""",
)
_both(
    "join_star",
    "SELECT r_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderstatus",
    logs=False,
)
_both("join_retail_filter", "SELECT s_name, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND l_discount > 0.05 GROUP BY s_name", logs=False)

# ---------------------------------------------------------------- subqueries

_both("subq_scalar", "SELECT service, count(*) AS n FROM logs WHERE ts > (SELECT min(ts) + INTERVAL '10' DAY FROM logs) GROUP BY service")
_both("subq_correlated", "SELECT a.event_id FROM logs a WHERE a.status > (SELECT avg(b.status) FROM logs b WHERE b.service = a.service)")
_both("subq_derived", "SELECT level, max(n) AS top FROM (SELECT level, service, count(*) AS n FROM logs GROUP BY level, service) t GROUP BY level")
_both("cte_chain", "WITH x AS (SELECT service, level, count(*) AS n FROM logs GROUP BY service, level), y AS (SELECT service, sum(n) AS total FROM x GROUP BY service) SELECT x.service, x.level, x.n, CAST(y.total AS BIGINT) AS total FROM x JOIN y ON x.service = y.service")
_both("subq_lateral", "SELECT s.service, t.n FROM (SELECT DISTINCT service FROM logs) s, LATERAL (SELECT count(*) AS n FROM logs l WHERE l.service = s.service AND l.level = 'ERROR') t")

# ---------------------------------------------------------------- windows

_both("win_rank", "SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter FROM logs WINDOW w AS (PARTITION BY service ORDER BY ts, event_id), v AS (PARTITION BY service ORDER BY status NULLS LAST)")
_both("win_distribution", "SELECT event_id, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM logs WINDOW w AS (PARTITION BY level ORDER BY ts)")
_both("win_lag_gap", "SELECT event_id, lag(event_id) OVER w AS before_id, lead(event_id, 2) OVER w AS after_id, first_value(event_id) OVER w AS first_id FROM logs WINDOW w AS (PARTITION BY service ORDER BY ts, event_id)")
_both(
    "win_running", "SELECT event_id, CAST(sum(coalesce(status, 0)) OVER (PARTITION BY service ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM logs",
    f"""WITH x AS (SELECT *, {_DAY} AS d FROM logs),
    c AS (SELECT service, d, coalesce(sum(total) OVER (PARTITION BY service ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT service, d, sum(coalesce(status, 0)) AS total FROM x GROUP BY service, d)),
    w AS (SELECT event_id, service, d, sum(coalesce(status, 0)) OVER (PARTITION BY service, d ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here FROM x)
    SELECT event_id, CAST(here + before AS BIGINT) AS running FROM w JOIN c USING (service, d)""")
_both("win_frame", "SELECT event_id, count(*) OVER (PARTITION BY service ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, nth_value(event_id, 2) OVER (PARTITION BY service ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS second FROM logs")
_both(
    "win_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY level ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM logs",
    # By hours: a row comes at its time and is gone an hour later, in the next hour; what is there then is a running sum over what the hour before holds.
    # Only running sums are taken, so a row costs the same in a full hour as in an empty one.
    """WITH x AS (SELECT event_id, level, epoch_millis(ts) AS ms FROM logs),
    p AS (SELECT event_id, level, ms - pmod(ms, 3600000) AS h, ms AS at, 0 AS gone FROM x UNION ALL SELECT NULL, level, ms - pmod(ms, 3600000) + 3600000, ms + 3600000, 1 FROM x WHERE ms IS NOT NULL)
    SELECT event_id, last_hour FROM (SELECT event_id, gone, sum(1 - 2 * gone) OVER (PARTITION BY level, h ORDER BY at, gone RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + sum(gone) OVER (PARTITION BY level, h ORDER BY at, gone RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_hour
    FROM p) WHERE gone = 0""")
_both("topk_per_service", "SELECT service, event_id, ts FROM (SELECT service, event_id, ts, row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id) AS rn FROM logs) t WHERE rn <= 3")

# ---------------------------------------------------------------- sets, order, grouping

_both("set_union", "SELECT service FROM logs WHERE level = 'ERROR' UNION SELECT level FROM logs")
_both("set_union_all", "SELECT service, status FROM logs WHERE status = 503 UNION ALL SELECT service, status FROM logs WHERE status IS NULL")
_both("set_intersect", "SELECT service, level FROM logs WHERE level <> 'DEBUG' INTERSECT SELECT service, level FROM logs WHERE status = 200")
_both("set_except", "SELECT event_id FROM logs WHERE level = 'INFO' EXCEPT SELECT event_id FROM logs WHERE status = 200")
_both("set_multiset", "SELECT service, status FROM logs EXCEPT ALL SELECT service, status FROM logs WHERE level = 'INFO'")
_both("set_intersect_all", "SELECT service, status FROM logs WHERE level <> 'INFO' INTERSECT ALL SELECT service, status FROM logs WHERE level <> 'ERROR'")
_both("agg_bool", "SELECT service, bool_and(status >= 200) AS every_one, bool_or(level = 'ERROR') AS any_error FROM logs GROUP BY service")
_both("agg_array", "SELECT service, array_to_string(list_sort(array_agg(DISTINCT level)), '|') AS levels FROM logs GROUP BY service", "SELECT service, array_join(array_sort(array_agg(DISTINCT level)), '|') AS levels FROM logs GROUP BY service")
_both("sort_limit_offset", "SELECT event_id, status FROM logs ORDER BY status NULLS FIRST, event_id DESC LIMIT 50 OFFSET 10")
_both("agg_grouping_sets", "SELECT service, level, count(*) AS n FROM logs GROUP BY GROUPING SETS ((service), (level), ())")
_both("agg_string_list", "SELECT service, string_agg(level, ',' ORDER BY level) AS levels FROM (SELECT DISTINCT service, level FROM logs) t GROUP BY service", "SELECT service, listagg(level, ',') WITHIN GROUP (ORDER BY level) AS levels FROM (SELECT DISTINCT service, level FROM logs) t GROUP BY service")
_both("agg_median", "SELECT service, CAST(median(event_id) AS DOUBLE) AS mid, var_samp(status) IS NULL AS flat FROM logs GROUP BY service")
_both("agg_retail_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", logs=False)

# ---------------------------------------------------------------- functions

_both("case_expr", "SELECT event_id, CASE WHEN status IS NULL THEN 'none' WHEN status >= 500 THEN 'bad' ELSE 'good' END AS verdict, coalesce(trace_id, '-') AS trace, nullif(service, 'auth') AS not_auth, greatest(event_id, 500) AS g, least(event_id, 500) AS l FROM logs")
_both("string_fns", "SELECT event_id, upper(service) AS u, length(message) AS n, substr(message, 3, 5) AS part, replace(message, 'e', '3') AS swapped, split_part(message, ' ', 2) AS second, concat(service, '/', level) AS joined, trim('  ' || level || ' ') AS bare, service LIKE 's%' AS starts FROM logs")
_both("regexp_fns", "SELECT event_id, regexp_extract(message, 'seq=([0-9]+)', 1) AS seq, regexp_replace(message, '[0-9]+', '#', 'g') AS masked, regexp_matches(message, 'time|user') AS hit FROM logs", "SELECT event_id, regexp_extract(message, 'seq=([0-9]+)', 1) AS seq, regexp_replace(message, '[0-9]+', '#') AS masked, message RLIKE 'time|user' AS hit FROM logs")
_both("date_fns", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(extract(day FROM ts) AS BIGINT) AS d, CAST(extract(hour FROM ts) AS BIGINT) AS hh, ts + INTERVAL '90' MINUTE AS later, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM logs", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(extract(day FROM ts) AS BIGINT) AS d, CAST(extract(hour FROM ts) AS BIGINT) AS hh, ts + INTERVAL '90' MINUTE AS later, epoch_millis(ts) AS ms FROM logs")
_both("shim_date_bin", "SELECT time_bucket(INTERVAL '90 seconds', ts, TIMESTAMP '1970-01-01') AS b, count(*) AS n FROM logs WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1", "SELECT date_bin(INTERVAL '90' SECOND, ts, TIMESTAMP_NTZ '1970-01-01') AS b, count(*) AS n FROM logs WHERE ts >= to_timestamp_millis(1704844800000) GROUP BY 1")
_both("math_fns", "SELECT event_id, abs(event_id - 500) AS a, CAST(floor(event_id / 7.0) AS BIGINT) AS f, CAST(ceil(event_id / 7.0) AS BIGINT) AS c, event_id % 7 AS m, round(sqrt(event_id), 6) AS r, round(power(event_id, 0.5), 6) AS p, TRY_CAST(trace_id AS BIGINT) AS never FROM logs", "SELECT event_id, abs(event_id - 500) AS a, CAST(floor(event_id / 7.0) AS BIGINT) AS f, CAST(ceil(event_id / 7.0) AS BIGINT) AS c, event_id % 7 AS m, round(sqrt(event_id), 6) AS r, round(power(event_id, 0.5), 6) AS p, TRY_CAST(trace_id AS BIGINT) AS never FROM logs")
_both("set_returning", "SELECT event_id, unnest(string_split(message, ' ')) AS word FROM logs", "SELECT event_id, explode(split(message, ' ')) AS word FROM logs")
_both("values_list", "SELECT v.level, v.weight, count(l.event_id) AS n FROM (VALUES ('ERROR', 4), ('WARN', 2), ('FATAL', 9)) AS v(level, weight) LEFT JOIN logs l ON l.level = v.level GROUP BY v.level, v.weight")
_both("select_star", "SELECT * FROM logs")

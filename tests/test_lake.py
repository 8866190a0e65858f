import json
import threading
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglake.api import LogLake
from loglake.config import Compaction, Config, Ingest, Query, from_dict, load
from loglake.model import LOG_COLUMNS, BadQuery, BadRequest, Conflict, Forbidden, ResultTooLarge
from loglake.operators import alerts, lifecycle, simstore
from loglake.operators.compact import bins
from loglake.operators.engine import single_value
from loglake.plans import cost
from loglake.plans.dsl import Fact
from loglake.plans.prune import select_files
from loglake.sources import generate, otlp, wire
from loglake.streaming import feeds

BASE = 1_700_000_000_000


def seeded(spark):
    """Twenty times an error of auth, a request of api and a detail of worker."""
    rows = [(BASE + i * 1000, level, service, 200, f"{service} event {i}", "traceme-123" if (level, i) == ("ERROR", 7) else None) for i in range(20) for level, service in (("ERROR", "auth"), ("INFO", "api"), ("DEBUG", "worker"))]
    df = spark.createDataFrame(rows, "ms long, level string, service string, status int, message string, trace_id string")
    return df.select(F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "level", "service", "status", "message", "trace_id", F.lit(None).cast("string").alias("attrs_json"))


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    out = LogLake(spark, str(tmp_path_factory.mktemp("lake")), clock=lambda: BASE + 60_000)
    out.ingest(seeded(spark))
    return out


def test_tiers_and_stats(lake):
    files = {r.tier: r for r in lake.catalog.files().collect()}
    assert set(files) == {"hot", "warm", "cold"} and sum(f.rows for f in files.values()) == 60
    assert (files["hot"].services, files["hot"].levels, files["hot"].row_groups) == (["auth"], ["ERROR"], 1)
    assert (files["cold"].min_ts, files["cold"].max_ts) == (BASE, BASE + 19_000)


def test_queries(lake):
    count = lake.query("SELECT service, count(*) AS n FROM logs GROUP BY service ORDER BY service")["rows"]
    assert [(r["service"], r["n"]) for r in count] == [("api", 20), ("auth", 20), ("worker", 20)]
    assert lake.query("SELECT count(*) AS n FROM logs", tiers=["hot"])["rows"] == [{"n": 20}]
    found = lake.query("trace_id:traceme-123")
    assert [r["message"] for r in found["rows"]] == ["auth event 7"] and found["stats"]["events"] == 1
    text = lake.query("auth")
    assert text["stats"]["files"] == 1 and text["stats"]["events"] == 20 and text["stats"]["row_groups_total"] >= 1
    assert lake.query("zzz-absent")["rows"] == []
    assert lake.query("level:error | last 50s")["stats"]["files"] == 1
    assert lake.audit.queries().count() >= 5


def test_refused(lake):
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE logs", "SELECT nothing FROM logs", "WITH x AS (SELECT 1) INSERT INTO logs SELECT 1"):
        with pytest.raises(BadQuery):
            lake.engine.sql(bad, lake.engine.scan([]))


def test_pruned_equals_unpruned(lake):
    everything = lake.engine.scan(r.path for r in lake.catalog.files().collect())
    for q in ("auth", "event 1", "service:api", "level:debug", "worker | last 45s", "e_ent", "nothing-here"):
        from loglake.plans.dsl import parse

        search = parse(q, lake.clock())
        picked = lake.engine.select(search)
        key = lambda d: sorted(map(str, search.apply(d, None).collect()))
        assert key(lake.engine.scan(f["path"] for f in picked.files)) == key(everything), q
        if picked.files:
            assert key(lake.engine.scan_row_groups(picked)) == key(everything), q


def test_ceilings(lake):
    engine = lake.engine
    all_rows = engine.scan(r.path for r in lake.catalog.files().collect())
    for config, fits in ((Query(max_result_rows=60), True), (Query(max_result_rows=59), False), (Query(max_result_bytes=100), False)):
        engine.config = replace(Config(), query=config)
        if fits:
            assert len(engine.rows(all_rows)) == 60
        else:
            with pytest.raises(ResultTooLarge):
                engine.rows(all_rows)
    engine.config = Config()
    assert len(engine.rows(all_rows)) == 60
    assert engine.arrow(all_rows.where("false")) == b""
    with pa.ipc.open_stream(engine.arrow(all_rows.orderBy("ts"))) as reader:
        table = reader.read_all()
    assert table.num_rows == 60 and not any("view" in str(t) for t in table.schema.types)
    assert "auth event 7" in engine.pretty(all_rows)


def test_estimate_is_the_selection(lake):
    for query, tiers in (("", None), ("service:auth", None), ("worker", ["cold"]), ("x | last 1m", ["hot", "cold"]), ("level:warn", [])):
        quote, search = lake.estimate(query, tiers), None
        from loglake.plans.dsl import parse

        search = parse(query, lake.clock())
        files = select_files(lake.catalog.files(trigrams=True), tiers, search.window, search.facts).collect()
        assert quote["bytes"] == sum(f.bytes for f in files) and quote["files_touched"] == len(files)


def test_same_batch_counts_once(spark, tmp_path):
    lake = LogLake(spark, str(tmp_path))
    assert not lake.ingest(seeded(spark)).deduped
    assert lake.ingest(seeded(spark).repartition(5)).deduped
    assert lake.engine.scan(r.path for r in lake.catalog.files().collect()).count() == 60


def test_batch_counts_once_after_merging(spark, tmp_path):
    config = replace(Config(), compaction=Compaction(trigger_files=2, target_bytes=10 << 20))
    lake = LogLake(spark, str(tmp_path), config=config)
    batches = [generate.generate(spark, 60, seed, BASE + seed * 1_000_000) for seed in range(2)]
    for b in batches:
        assert not lake.ingest(b).deduped
    lake.compactor.maybe_compact()
    lake.catalog.tidy(most=0)
    assert [lake.ingest(b).deduped for b in batches] == [True, True]
    assert lake.frame("").count() == 120


def test_one_batch_from_two_senders(spark, tmp_path):
    """Both pass the first look; the commit lets one of them in."""
    lakes = [LogLake(spark, str(tmp_path)) for _ in range(2)]
    for lk in lakes:
        lk.catalog.has = lambda batch, head=None, real=lk.catalog.has: head is not None and real(batch, head)
    assert [lk.ingest(seeded(spark)).deduped for lk in lakes] == [False, True]
    assert lakes[0].engine.scan(r.path for r in lakes[0].catalog.files().collect()).count() == 60


def test_late_compaction_is_refused(spark, tmp_path):
    """A plan made before another compaction, and before the manifest was tidied, must not add its copies."""
    config = replace(Config(), compaction=Compaction(trigger_files=2, target_bytes=10 << 20))
    lake = LogLake(spark, str(tmp_path), config=config)
    for seed in range(2):
        lake.ingest(generate.generate(spark, 60, seed, BASE + seed * 1_000_000))
    plan = {tier: [[r["path"] for r in b] for b in made] for tier, made in lake.compactor._plan(10 << 20).items() if made}
    lake.compactor.maybe_compact()
    lake.catalog.tidy(most=0)
    for tier, made in plan.items():
        with pytest.raises(Conflict):
            lake.compactor._merge(tier, made[0])
    assert lake.frame("").count() == 120


def test_slow_alert_writer(spark, tmp_path):
    """A writer whose base version has long been deleted starts over instead of being ignored."""
    from loglake.operators import alerts

    rules = LogLake(spark, str(tmp_path)).rules
    rule = lambda k: alerts.Rule(f"r{k}", "SELECT 1 AS v", "gt", 0.0)
    for k in range(3):
        rules._change(lambda known, k=k: [*known, rule(k)])
    stale, fresh = rules._latest(), rules._latest
    for k in range(3, alerts.KEPT + 8):
        rules._change(lambda known, k=k: [*known, rule(k)])
    seen = iter([stale])
    rules._latest = lambda: next(seen, None) or fresh()
    rules._change(lambda known: [*known, rule(99)])
    names = [r.name for r in LogLake(spark, str(tmp_path)).rules.rules()]
    assert names == [*(f"r{k}" for k in range(alerts.KEPT + 8)), "r99"]


def test_concurrent_writers(spark, tmp_path):
    lakes = [LogLake(spark, str(tmp_path)) for _ in range(2)]
    jobs = [threading.Thread(target=lk.ingest, args=(generate.generate(spark, 200, seed),)) for seed, lk in enumerate(lakes)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert lakes[0].engine.scan(r.path for r in lakes[0].catalog.files().collect()).count() == 400


def test_compaction(spark, tmp_path):
    config = replace(Config(), compaction=Compaction(trigger_files=4, target_bytes=10 << 20))
    lake = LogLake(spark, str(tmp_path), config=config)
    for seed in range(5):
        lake.ingest(generate.generate(spark, 60, seed, BASE + seed * 1_000_000))
    before = lake.catalog.files()
    rows = sorted(map(str, lake.engine.scan(r.path for r in before.collect()).collect()))
    pending = lake.compactor.pending()
    assert pending == {"hot": 5, "warm": 5, "cold": 5}
    version = lake.catalog.head()["version"]
    reports = lake.compactor.maybe_compact()
    assert {r.tier: r.files_merged for r in reports} == pending
    after = lake.catalog.files().collect()
    assert len(after) == 3 and sorted(map(str, lake.engine.scan(r.path for r in after).collect())) == rows
    assert lake.catalog.head()["compaction_gen"] == 3
    assert lake.catalog.files(version).count() == 15  # time travel
    assert lake.compactor.pending() == {"hot": 0, "warm": 0, "cold": 0}
    assert len(lake.compactor.vacuum()) == 15
    assert lake.query("SELECT count(*) AS n FROM logs")["rows"] == [{"n": 300}]
    assert lake.catalog.tidy(1)["dropped"] == [] and lake.catalog.files().count() == 3


def test_bins():
    assert bins([5, 5, 5, 20, 1], 10) == [[0, 1], [2, 3], [4]]
    assert bins([], 10) == []


def test_row_groups(spark, tmp_path):
    config = replace(Config(), ingest=Ingest(row_group_rows=64))
    lake = LogLake(spark, str(tmp_path), config=config, clock=lambda: BASE)
    rows = spark.range(1024).select(F.timestamp_millis(F.lit(BASE) + F.col("id") * 10).cast("timestamp_ntz").alias("ts"), F.lit("INFO").alias("level"), F.lit("s").alias("service"), F.lit(1).alias("status"), F.concat(F.when(F.col("id") == 700, "quasar ").otherwise("cache "), F.col("id").cast("string")).alias("message"), F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("attrs_json"))
    lake.ingest(rows.coalesce(1))
    from loglake.plans.dsl import parse

    for word, groups in (("quasar", 1), ("cache", 16), ("zzz-absent", 0)):
        picked = lake.engine.select(parse(word, BASE))
        assert (picked.groups_scanned, len(picked.files)) == (groups, int(groups > 0)), word
    assert lake.engine.scan_row_groups(lake.engine.select(parse("quasar", BASE))).count() == 64


def test_bodies(spark, tmp_path):
    lake = LogLake(spark, str(tmp_path))
    good = '{"ts_millis": 5, "service": "a", "message": "m", "level": "Warning", "attrs": {"b": "2", "a": "1"}}'
    done = lake.ingest_body(f"{good}\nnot json\n\n{good.replace('"m"', '"n"')}")
    assert (done["ingested"], done["skipped"], done["first_error"][:7]) == (2, 1, "line 2:")
    row = lake.query("m")["rows"][0]
    assert (row["level"], row["attrs_json"]) == ("WARN", '{"a":"1","b":"2"}')
    for bad in ("", "\n \n", "nothing", f"[{good}, 3]", "[", '{"service": "x"}'):
        with pytest.raises(BadRequest):
            lake.ingest_body(bad)
    assert lake.ingest_body(f"[{good.replace('"m"', '"o"')}]")["ingested"] == 1


def test_ndjson_file_fails_as_a_whole(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"ts_millis": 1, "service": "", "message": "m"}\n\n')
    assert wire.read_ndjson(spark, str(path)).first().level == "INFO"
    path.write_text('{"ts_millis": 1, "service": "", "message": "m"}\nbad\n')
    with pytest.raises(Exception, match="not a log record"):
        wire.read_ndjson(spark, str(path)).collect()


def test_otlp(spark):
    value = lambda **k: {"value": k}
    record = {"timeUnixNano": "0", "observedTimeUnixNano": 5_000_000, "severityText": "fatal", "body": {"stringValue": "hi"}, "traceId": "", "attributes": [{"key": "http.status_code", **value(intValue="503")}, {"key": "status", **value(intValue=1)}, {"key": "l", **value(arrayValue={})}, {"key": "zone", **value(boolValue=True)}]}
    request = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", **value(stringValue="svc")}, {"key": "zone", **value(stringValue="x")}]}, "scopeLogs": [{"logRecords": [record, {"severityNumber": 5}]}]}, {"scopeLogs": [{"logRecords": [{"severityNumber": "13"}]}]}]}
    rows = otlp.parse(spark.createDataFrame([(json.dumps(request),), ("{}",)], "value string")).collect()
    got = [(r.ts.microsecond // 1000, r.level, r.service, r.status, r.message, r.trace_id, r.attrs_json) for r in rows]
    assert got[0] == (5, "ERROR", "svc", 503, "hi", None, '{"http.status_code":"503","service.name":"svc","status":"1","zone":"true"}')
    assert got[1][1:5] == ("DEBUG", "svc", None, "") and got[2][1:5] == ("WARN", "", None, "")


def test_generate(spark):
    a = generate.generate(spark, 500, 3).collect()
    assert a == generate.generate(spark.newSession(), 500, 3).repartition(7).orderBy("ts").collect()
    assert all(x.ts < y.ts for x, y in zip(a, a[1:], strict=False)) and {r.service for r in a} == set(generate.SERVICES)


def test_selection_facts(spark):
    rows = [("a", 1000, 1, 0, 100, "hot", ["auth"], ["ERROR"], 1, None), ("b", 3000, 1, 900, 1000, "hot", ["billing"], ["ERROR"], 1, None), ("c", 500, 1, 0, 1000, "cold", [], None, 1, None)]
    files = spark.createDataFrame(rows, "path string, bytes long, rows long, min_ts long, max_ts long, tier string, services array<string>, levels array<string>, row_groups long, trigrams array<int>")
    got = lambda **k: sorted(r.path for r in select_files(files, **k).collect())
    assert got(facts=[Fact("service", "auth")]) == ["a", "c"]
    assert got(facts=[Fact("text", "db"), Fact("text", "database")]) == ["a", "b", "c"]
    assert got(window=(800, 1000)) == ["b", "c"] and got(window=(100, None)) == ["a", "b", "c"] and got(window=(101, 899)) == ["c"]
    assert got(tiers=["hot"]) == ["a", "b"] and got(tiers=["x"]) == []
    assert cost.estimate_scan(files, ["cold"], mode="standard")["restore_ms"] == 4 * 3_600_000


def test_alert_steps(lake):
    rule = alerts.Rule("r", "SELECT count(*) AS v FROM logs WHERE level = 'ERROR'", "gt", 10)
    fired, change = alerts.step(rule, 11, 5)
    assert (change, fired.status.since_ms) == ("fired", 5)
    again, change = alerts.step(fired, 12, 9)
    assert (change, again.status.since_ms, again.status.last_eval_ms) == ("unchanged", 5, 9)
    assert alerts.step(again, 10, 11)[1] == "resolved"
    lake.create_alert(rule)
    with pytest.raises(BadQuery):
        lake.create_alert(alerts.Rule("bad", "SELECT oops FROM logs", "gt", 1))
    sent = []
    assert lake.evaluate_alerts(sent.append)[0][1] == "fired" and sent[0]["value"] == 20
    assert lake.evaluate_alerts(sent.append)[0][1] == "unchanged" and len(sent) == 1
    assert lake.rules.remove(rule.id) and not lake.rules.remove(rule.id)
    assert len(lake.rules.seed("logs")) == 2 and lake.rules.seed("logs") == []


def test_single_value(spark):
    assert single_value(spark.sql("SELECT 'x' AS a, 3 AS b, 5.5 AS v")) == 5.5
    assert single_value(spark.sql("SELECT 'x' AS a, 3 AS b, 'y' AS v")) == 3
    assert single_value(spark.sql("SELECT 'x' AS a")) == single_value(spark.sql("SELECT 1 AS v WHERE false")) == 0


def test_tokens(lake):
    token, secret = lake.tokens.issue("ci", "readwrite", 1)
    assert lake.tokens.require(secret, "ingest") == "readwrite" and secret not in str(lake.tokens.list())
    for secret_, op in ((secret, "tokens"), (None, "query"), ("nope", "query")):
        with pytest.raises(Forbidden):
            lake.tokens.require(secret_, op)
    assert lake.tokens.revoke(token.id) and lake.tokens.role_of(secret) is None


def test_pages(lake):
    assert {r["tier"] for r in lake.storage()} == {"hot", "warm", "cold"}
    assert lake.cost(60)["projected_usd"] == pytest.approx(2 * lake.cost()["month_usd"])
    assert lake.pipelines()["ingest_lag_s"] == 41
    page = lake.metrics()
    assert page["tiles"]["error_rate"] == pytest.approx(100 / 3) and len(page["volume"]) == 3
    assert lake.health() and lake.settings()["query"]["cores"] == 4 and "query_seconds_bucket" in lake.counters.text()


def test_simulated_store():
    s = simstore.SimStore()
    s.put("a", 64 << 20, "GlacierFlexible")
    with pytest.raises(simstore.NotThawed):
        s.get("a")
    s.advance(s.restore("a") - s.now_ms)
    s.get("a")
    assert s.usd == pytest.approx(64 / 1024 * 0.01)
    s.put("b", 1)
    s.advance(31 * 86_400_000)
    s.age()
    assert s.objects["b"].storage_class == "GlacierFlexible"
    s.advance(400 * 86_400_000)
    assert set(s.age()) == {"a", "b"}
    with pytest.raises(simstore.InjectedFault):
        simstore.SimStore(fault_ppm=1_000_000).put("x", 1)


def test_config(tmp_path):
    assert load(environ={}) == Config()
    path = tmp_path / "c.toml"
    path.write_text("[routing]\ninfo = 'cold'\n[query]\ncores = 8\n")
    c = load(str(path), {"LOGLAKE_API_TOKEN": "t"})
    assert (c.routing.tier("INFO"), c.query.cores, c.auth.enabled) == ("cold", 8, True)
    for bad in ({"routing": {"info": "lava"}}, {"nope": {}}, {"query": {"x": 1}}):
        with pytest.raises(ValueError, match="."):
            from_dict(bad)
    assert lifecycle.policy("logs")["Rules"][0]["Filter"] == {"Prefix": "logs/"}


def test_streaming(spark, tmp_path):
    lake = LogLake(spark, str(tmp_path / "lake"))
    landing = tmp_path / "landing"
    landing.mkdir()
    line = lambda i: json.dumps({"ts_millis": BASE + i, "service": "s", "message": f"m{i}", "level": ["error", "info", "debug"][i % 3]})
    (landing / "a.json").write_text("\n".join([*map(line, range(6)), "broken"]))
    reports = []
    for _ in range(2):
        feeds.ingest_stream(lake.ingestor, str(landing), str(tmp_path / "cp"), report=reports.append).awaitTermination()
        (landing / "b.json").write_text("\n".join(map(line, range(6, 9))))
    assert [(r["ingested"], r["skipped"]) for r in reports] == [(6, 1), (3, 0)]
    q = lake.tail(BASE + 3).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.message for r in spark.table("tailed").collect()) == ["m4", "m5", "m6", "m7", "m8"]
    assert spark.table("tailed").columns == list(LOG_COLUMNS)
    assert next(iter(feeds.events(spark.table("tailed").limit(0)))).startswith(":")
    frames = feeds.landing(spark, str(landing)).where("_corrupt IS NULL")
    bars = feeds.windowed(wire.to_logs(frames), "1 second", "1 second").writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start()
    bars.awaitTermination()
    assert [(r.total, r.errors) for r in spark.table("bars").collect()] == [(9, 3)]
    (tmp_path / "evals").mkdir()
    evals = spark.readStream.schema("rule string, eval_ms long, v double").json(str(tmp_path / "evals"))
    (tmp_path / "evals" / "1.json").write_text("\n".join(json.dumps({"rule": "r", "eval_ms": i, "v": v}) for i, v in enumerate([1, 5, 6, 0])))
    q = feeds.alert_states(evals, 3).writeStream.format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.transition for r in spark.table("states").orderBy("eval_ms").collect()] == ["unchanged", "fired", "unchanged", "resolved"]

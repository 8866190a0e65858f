import json
import threading
import urllib.request
from dataclasses import replace

import pytest

from loglake import cli
from loglake.api import LogLake
from loglake.config import Auth, Config, Ingest
from loglake.functions.words import host, humanize, number
from loglake.operators.alerts import Rule
from loglake.operators.ingest import rows_a_file
from loglake.service import Repeater, Service, server

NOW = 1_700_000_060_000
LINES = "\n".join(json.dumps({"ts_millis": 1_700_000_000_000 + i, "service": "auth", "message": f"event {i}", "level": "error" if i % 2 else "info"}) for i in range(10))


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    config = replace(Config(), auth=Auth(True, "root-secret"), ingest=Ingest(max_in_flight=1, max_body_bytes=5_000))
    return Service(LogLake(spark, str(tmp_path_factory.mktemp("lake")), config=config, clock=lambda: NOW))


def ask(service, method, target, body=None, secret="root-secret"):
    status, kind, out = service.answer(method, target, body if isinstance(body, bytes) else json.dumps(body or {}).encode(), secret)
    return status, json.loads(out) if kind == "application/json" else out


def test_routes(service):
    assert ask(service, "POST", "/v1/ingest", LINES.encode())[1]["ingested"] == 10
    status, found = ask(service, "POST", "/v1/query", {"sql": "SELECT level, count(*) AS n FROM logs GROUP BY level ORDER BY level"})
    assert status == 200 and found["rows"] == [{"level": "ERROR", "n": 5}, {"level": "INFO", "n": 5}]
    assert ask(service, "POST", "/v1/query/estimate", {"sql": "level:error"})[1]["files_touched"] == 1
    assert ask(service, "GET", "/v1/audit/queries")[1][0]["user"] == "configured-admin"
    for page in ("metrics", "storage/tiers", "cost?days=90", "pipelines", "settings", "alerts", "auth/tokens"):
        assert ask(service, "GET", f"/v1/{page}")[0] == 200
    assert ask(service, "GET", "/v1/settings")[1]["auth"]["api_token"] == "***"
    assert ask(service, "GET", "/healthz", secret=None) == (200, b"ok")
    assert b"loglake_ingested_rows 10" in ask(service, "GET", "/metrics", secret=None)[1]


def test_refusals(service):
    assert ask(service, "POST", "/v1/query", {"sql": "SELECT 1; SELECT 2"})[0] == 400
    assert ask(service, "POST", "/v1/query", b"{")[0] == 400
    assert ask(service, "POST", "/v1/ingest", b"\xff")[0] == 400
    assert ask(service, "POST", "/v1/ingest", b"x" * 5_001)[0] == 413
    assert ask(service, "GET", "/v1/nothing")[0] == 404
    assert ask(service, "GET", "/v1/cost?days=x")[0] == 400
    with service._room:
        assert ask(service, "POST", "/v1/ingest", LINES.encode())[0] == 429


def test_roles(service):
    made = ask(service, "POST", "/v1/auth/tokens", {"name": "ann", "role": "readonly"})[1]
    assert ask(service, "GET", "/v1/alerts", secret=None)[0] == 401 and ask(service, "GET", "/v1/alerts", secret="no")[0] == 401
    assert ask(service, "GET", "/v1/alerts", secret=made["secret"])[0] == 200
    assert ask(service, "GET", f"/v1/alerts?access_token={made['secret']}", secret=None)[0] == 200
    assert ask(service, "POST", "/v1/ingest", LINES.encode(), made["secret"])[0] == 403
    # A token that another node revoked is refused once the copy is read again.
    service.lake.tokens.revoke(made["id"])
    assert ask(service, "GET", "/v1/alerts", secret=made["secret"])[0] == 200
    service.sessions.refresh()
    assert ask(service, "GET", "/v1/alerts", secret=made["secret"])[0] == 401
    assert ask(service, "POST", "/v1/auth/tokens", {"name": "x", "role": "king"})[0] == 400


def test_alert_routes(service):
    told = []
    rule = {"name": "errors", "sql": "SELECT count(*) AS v FROM logs WHERE level = 'ERROR'", "comparator": "gt", "threshold": 1, "webhook": "https://hooks.example/a/b"}
    made = ask(service, "POST", "/v1/alerts", rule)[1]
    service.lake.evaluate_alerts(told.append)
    assert [(t["alert"], t["state"], t["value"]) for t in told] == [("errors", "firing", 5.0)]
    shown = ask(service, "GET", "/v1/alerts")[1][0]
    assert (shown["condition"], shown["current"], shown["webhook"], shown["for"]) == ("gt 1", "5", "hooks.example", "0s")
    assert ask(service, "POST", "/v1/alerts", {**rule, "sql": "SELECT nope FROM logs"})[0] == 400
    assert ask(service, "DELETE", f"/v1/alerts/{made['id']}")[0] == 200 and ask(service, "DELETE", f"/v1/alerts/{made['id']}")[0] == 404


def test_failing_webhook_keeps_states(service):
    def fail(notice):
        raise OSError("unreachable")

    service.lake.create_alert(Rule("any", "SELECT count(*) AS v FROM logs", "gt", 0))
    assert [change for _, change in service.lake.evaluate_alerts(fail)] == ["fired"]
    assert service.lake.rules.rules()[0].status.state == "firing"


def test_tail(service, monkeypatch):
    before = iter([1_700_000_000_004])
    newest = service.lake.newest
    monkeypatch.setattr(service.lake, "newest", lambda: next(before, None) or newest())
    got = list(service.tail("", polls=2, pause=0))
    assert [json.loads(e.decode()[6:])["message"] for e in got[:-1]] == [f"event {i}" for i in range(5, 10)] and got[-1] == b": keep-alive\n\n"


def test_socket(service):
    with server(service, port=0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        root = f"http://127.0.0.1:{http.server_address[1]}"
        assert urllib.request.urlopen(f"{root}/healthz", timeout=20).read() == b"ok"
        request = urllib.request.Request(f"{root}/v1/query", json.dumps({"sql": "event 3"}).encode(), {"Authorization": "Bearer root-secret"})
        assert [r["message"] for r in json.load(urllib.request.urlopen(request, timeout=60))["rows"]] == ["event 3"]
        http.shutdown()


def test_repeater():
    done, failures = threading.Event(), []

    def call():
        if not failures:
            raise ValueError("once")
        done.set()

    r = Repeater(0.01, call, failures.append).start()
    assert done.wait(5)
    r.stop()
    assert len(failures) == 1 and r.runs >= 2


def test_follow(spark, tmp_path, capsys):
    lake = LogLake(spark, str(tmp_path), clock=lambda: NOW)
    cli.follow(lake, 20, 3, 0.0, ticks=2)
    assert lake.engine.scan(r.path for r in lake.catalog.files().collect()).count() == 40
    assert capsys.readouterr().out.count("ingested=20") == 2


def test_words():
    assert [humanize(n) for n in (0, 59_999, 60_000, 7_200_000, 172_800_000)] == ["0s", "59s", "1m", "2h", "2d"]
    assert [number(v) for v in (3.0, -2.0, 0.256, 1e16)] == ["3", "-2", "0.26", "10000000000000000.00"]
    assert [host(u) for u in ("https://a.example:9/x/y", "b.example/z")] == ["a.example:9", "b.example"]


def test_files_roll_by_rows_or_bytes():
    limits = replace(Config(), ingest=Ingest(roll_rows=1000, roll_bytes=10_000))
    assert [rows_a_file(limits, 100, n) for n in (0, 100, 100_000, 10**9)] == [1000, 1000, 10, 1]


def test_audit_is_pruned(spark, tmp_path, monkeypatch):
    from loglake.operators import audit

    monkeypatch.setattr(audit, "CAP", 5)
    monkeypatch.setattr(audit, "PRUNE_EVERY", 4)
    lake = LogLake(spark, str(tmp_path), clock=lambda: NOW)
    for i in range(12):
        lake.audit.record(i, "u", f"q{i}", i, 0.0, None)
    assert [r["sql"] for r in lake.queries()] == [f"q{i}" for i in range(11, 6, -1)] and len(lake.store.list(lake.audit.home)) == 5

"""A lake over HTTP, with its schedules: python -m loglake.cli serve

Requests are answered by threads of the driver, which only plan and hand over bounded results; rows are made on executors.
At most ``max_in_flight`` writes run at once, others are told to come again. Only the command line imports this module.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .api import LogLake
from .model import BadRequest, LogLakeError
from .operators.access import Sessions
from .operators.alerts import Rule, post
from .streaming.feeds import events, tail_page

#: Operation, method and path of each route; a group in the path is handed on.
ROUTES = (
    ("ingest", "POST", r"/v1/ingest"), ("ingest_otlp", "POST", r"/v1/otlp/logs"), ("query", "POST", r"/v1/query"), ("estimate", "POST", r"/v1/query/estimate"),
    ("metrics", "GET", r"/v1/metrics"), ("storage", "GET", r"/v1/storage/tiers"), ("cost", "GET", r"/v1/cost"), ("pipelines", "GET", r"/v1/pipelines"), ("settings", "GET", r"/v1/settings"),
    ("alerts", "GET", r"/v1/alerts"), ("create_alert", "POST", r"/v1/alerts"), ("remove_alert", "DELETE", r"/v1/alerts/([^/]+)"),
    ("tail", "GET", r"/v1/tail"), ("audit", "GET", r"/v1/audit/queries"), ("tokens", "GET", r"/v1/auth/tokens"), ("issue_token", "POST", r"/v1/auth/tokens"), ("revoke_token", "DELETE", r"/v1/auth/tokens/([^/]+)"),
    ("health", "GET", r"/healthz"), ("prometheus", "GET", r"/metrics"),
)
OPEN, WRITES = ("health", "prometheus"), ("ingest", "ingest_otlp")
#: Seconds between runs of a schedule; compaction has its own setting.
ALERTS_S, TOKENS_S, TAIL_S = 15.0, 20.0, 1.0


class Busy(LogLakeError):
    status = 429


class TooLarge(LogLakeError):
    status = 413


class Absent(LogLakeError):
    status = 404


class Repeater:
    """Calls a function every so many seconds on a thread of its own until stopped; a failing call is handed to ``failed``."""

    def __init__(self, seconds: float, call: Callable[[], object], failed: Callable[[Exception], None] = lambda e: None) -> None:
        self.seconds, self.call, self.failed, self.runs = seconds, call, failed, 0
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._stop.wait(self.seconds):
            try:
                self.call()
            except Exception as e:  # noqa: BLE001  the next run is due all the same
                self.failed(e)
            self.runs += 1

    def start(self) -> Repeater:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join(self.seconds + 5)


class Service:
    """Routes of one lake, callable without a socket: :meth:`answer` gives (status, content type, body)."""

    def __init__(self, lake: LogLake, notify: Callable[[dict], None] = post) -> None:
        self.lake, self.notify = lake, notify
        self.sessions = Sessions(lake.tokens, lake.config.auth)
        self._room = threading.BoundedSemaphore(lake.config.ingest.max_in_flight)
        self._schedules: list[Repeater] = []

    # ------------------------------------------------------------ schedules

    def start(self) -> None:
        """Alerts, compaction and the token cache, each on its own clock."""
        failed = lambda e: self.lake.counters.add("schedule_failures")
        every = [(ALERTS_S, lambda: self.lake.evaluate_alerts(self.notify)), (TOKENS_S, self.sessions.refresh)]
        if self.lake.config.compaction.enabled:
            every.append((self.lake.config.compaction.every_seconds, self.lake.compactor.maybe_compact))
        self._schedules = [Repeater(s, call, failed).start() for s, call in every]

    def stop(self) -> None:
        for s in self._schedules:
            s.stop()

    # ------------------------------------------------------------ requests

    def answer(self, method: str, target: str, body: bytes = b"", secret: str | None = None) -> tuple[int, str, bytes | Iterator[bytes]]:
        parts = urlsplit(target)
        args = {k: v[-1] for k, v in parse_qs(parts.query).items()}
        try:
            for operation, verb, path in ROUTES:
                if verb == method and (found := re.fullmatch(path, parts.path)):
                    user = "anonymous" if operation in OPEN else self.sessions.require(secret or args.get("access_token"), operation)
                    return self._run(operation, found.groups(), args, body, user)
            raise Absent(f"no route {method} {parts.path}")
        except LogLakeError as e:
            return e.status, "application/json", json.dumps({"error": str(e)}).encode()
        except Exception as e:  # noqa: BLE001  a request must not end the server
            return 500, "application/json", json.dumps({"error": str(e)[:500]}).encode()

    def _run(self, operation: str, groups: tuple, args: dict, body: bytes, user: str) -> tuple[int, str, bytes | Iterator[bytes]]:
        if operation == "health":
            return (200 if self.lake.health() else 503), "text/plain", b"ok"
        if operation == "prometheus":
            return 200, "text/plain; version=0.0.4", self.lake.counters.text().encode()
        if operation == "tail":
            return 200, "text/event-stream", self.tail(args.get("query", ""))
        if operation in WRITES:
            out = self._write(operation, body)
        else:
            out = getattr(self, f"_{operation}")(*groups, args=args, body=body, user=user)
        return 200, "application/json", json.dumps(out, default=str).encode()

    def _write(self, operation: str, body: bytes) -> dict:
        if len(body) > self.lake.config.ingest.max_body_bytes:
            raise TooLarge("the body is too large")
        if not self._room.acquire(blocking=False):
            raise Busy("too many requests in flight")
        try:
            return (self.lake.ingest_body if operation == "ingest" else self.lake.ingest_otlp)(body.decode())
        except UnicodeDecodeError as e:
            raise BadRequest("the body is not UTF-8") from e
        finally:
            self._room.release()

    def _query(self, args, body, user):
        ask = _object(body)
        return self.lake.query(ask.get("sql", ""), ask.get("tiers"), user=user)

    def _estimate(self, args, body, user):
        ask = _object(body)
        return self.lake.estimate(ask.get("sql", ""), ask.get("tiers"), ask.get("mode", "standard"))

    def _metrics(self, args, body, user):
        return self.lake.metrics()

    def _storage(self, args, body, user):
        return self.lake.storage()

    def _cost(self, args, body, user):
        try:
            return self.lake.cost(int(args.get("days", 30)))
        except ValueError as e:
            raise BadRequest("days is no number") from e

    def _pipelines(self, args, body, user):
        return self.lake.pipelines()

    def _settings(self, args, body, user):
        return self.lake.settings()

    def _alerts(self, args, body, user):
        return self.lake.alerts()

    def _create_alert(self, args, body, user):
        try:
            rule = Rule(**{k: v for k, v in _object(body).items() if k in ("name", "sql", "comparator", "threshold", "severity", "webhook", "enabled")})
        except TypeError as e:
            raise BadRequest(str(e)) from e
        return asdict(self.lake.create_alert(rule))

    def _remove_alert(self, rule_id, args, body, user):
        if not self.lake.rules.remove(rule_id):
            raise Absent("no such alert")
        return {"removed": rule_id}

    def _audit(self, args, body, user):
        return self.lake.queries()

    def _tokens(self, args, body, user):
        return [{k: v for k, v in asdict(t).items() if k != "hash"} for t in self.lake.tokens.list()]

    def _issue_token(self, args, body, user):
        ask = _object(body)
        try:
            token, secret = self.lake.tokens.issue(ask.get("name", ""), ask.get("role", "readonly"), self.lake.clock())
        except ValueError as e:
            raise BadRequest(str(e)) from e
        self.sessions.refresh()
        return {"id": token.id, "name": token.name, "role": token.role, "secret": secret}

    def _revoke_token(self, token_id, args, body, user):
        if not self.lake.tokens.revoke(token_id):
            raise Absent("no such token")
        self.sessions.refresh()
        return {"revoked": token_id}

    def tail(self, query: str = "", polls: int | None = None, pause: float = TAIL_S) -> Iterator[bytes]:
        """Server-sent events of records newer than the newest at the start; pages follow each other without a pause while full."""
        newest = self.lake.newest()
        while polls is None or polls > 0:
            page = tail_page(self.lake.frame(query or "", limit=1 << 30), newest) if self.lake.newest() > newest else None
            rows = page.collect() if page is not None else []
            # A page that ends inside one millisecond goes on to that millisecond's end, so that ties are not lost.
            if len(rows) == 100:
                page = tail_page(self.lake.frame(query or "", limit=1 << 30).where("unix_millis(cast(ts AS timestamp)) <= " + str(rows[-1]["ts_millis"])), newest, 1 << 30)
                rows = page.collect()
            if rows:
                newest = rows[-1]["ts_millis"]
                yield from (e.encode() for e in events(self.lake.spark.createDataFrame(rows, page.schema)))
            else:
                yield b": keep-alive\n\n"
                time.sleep(pause)
            polls = None if polls is None else polls - 1


def _object(body: bytes) -> dict:
    try:
        out = json.loads(body or b"{}")
    except ValueError as e:
        raise BadRequest(f"invalid JSON: {e}") from e
    if not isinstance(out, dict):
        raise BadRequest("a JSON object is expected")
    return out


def server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """The socket; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _handle(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
            except ValueError:
                size = 0
            if size > service.lake.config.ingest.max_body_bytes:
                # Refused unread.
                status, kind, out = 413, "application/json", b'{"error": "the body is too large"}'
                self.close_connection = True
            else:
                bearer = self.headers.get("Authorization", "")
                secret = bearer.removeprefix("Bearer ").strip() if bearer.startswith("Bearer ") else None
                status, kind, out = service.answer(self.command, self.path, self.rfile.read(size), secret)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if isinstance(out, bytes):
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)
                return
            self.end_headers()
            try:
                for piece in out:
                    self.wfile.write(piece)
                    self.wfile.flush()
            except OSError:
                pass  # the listener went away

        do_GET = do_POST = do_DELETE = _handle

        def log_message(self, *_: object) -> None:
            """Requests are counted, not logged."""

    return ThreadingHTTPServer((host, port), Handler)


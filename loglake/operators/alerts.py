"""Threshold alerts: rules, a two-state machine, evaluation over a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BadQuery, Conflict
from .engine import Engine, single_value
from .files import Store

COMPARE = {"gt": lambda v, t: v > t, "ge": lambda v, t: v >= t, "lt": lambda v, t: v < t, "le": lambda v, t: v <= t}
FIRED, RESOLVED, UNCHANGED = "fired", "resolved", "unchanged"
ATTEMPTS = 4


@dataclass(frozen=True)
class Status:
    state: str = "ok"
    value: float = 0.0
    since_ms: int = 0
    last_eval_ms: int = 0


@dataclass(frozen=True)
class Rule:
    name: str
    sql: str
    comparator: str
    threshold: float
    severity: str = "warning"
    webhook: str | None = None
    enabled: bool = True
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: Status = Status()

    def __post_init__(self) -> None:
        if self.comparator not in COMPARE:
            raise BadQuery(f"unknown comparator {self.comparator!r}")


def step(rule: Rule, value: float, now_ms: int) -> tuple[Rule, str]:
    """The rule after an evaluation and what changed. The start of a state moves only with the state."""
    old = rule.status
    state = "firing" if COMPARE[rule.comparator](value, rule.threshold) else "ok"
    turned = state != old.state
    new = Status(state, value, now_ms if turned else old.since_ms, now_ms)
    return replace(rule, status=new), (FIRED if state == "firing" else RESOLVED) if turned else UNCHANGED


def transitions(series: DataFrame, comparator: str, threshold: float) -> DataFrame:
    """The state machine over a table of evaluations (rule, eval_ms, v): state, and the transition into it."""
    test = {"gt": F.col("v") > threshold, "ge": F.col("v") >= threshold, "lt": F.col("v") < threshold, "le": F.col("v") <= threshold}[comparator]
    state = F.when(test, "firing").otherwise("ok")
    before = F.lag("state", 1, "ok").over(Window.partitionBy("rule").orderBy("eval_ms"))
    change = F.when(F.col("state") == before, UNCHANGED).when(F.col("state") == "firing", FIRED).otherwise(RESOLVED)
    return series.withColumn("state", state).withColumn("transition", change)


#: Versions of the rules that stay beside the newest.
KEPT = 32


class Alerts:
    """Rules of a table, kept beside its catalog in versions that are created exclusively."""

    def __init__(self, store: Store, table: str) -> None:
        self.store, self.home = store, f"{table}/_alerts"

    def _latest(self) -> tuple[int, list[Rule]]:
        known = [n for n, _ in self.store.list(self.home) if n.endswith(".json")]
        if not known:
            return 0, []
        data = json.loads(self.store.read(f"{self.home}/{known[-1]}"))
        return int(known[-1][:-5]), [Rule(**{**r, "status": Status(**r["status"])}) for r in data]

    def rules(self) -> list[Rule]:
        return self._latest()[1]

    def _change(self, edit: Callable[[list[Rule]], list[Rule]]) -> list[Rule]:
        for _ in range(ATTEMPTS):
            version, rules = self._latest()
            new = edit(rules)
            if self.store.create(f"{self.home}/{version + 1:012d}.json", json.dumps([asdict(r) for r in new]).encode()):
                newest, _ = self._latest()
                if newest != version + 1 and newest - version > KEPT:
                    # Others went on so far that this number had been deleted and was free again: the change never counted.
                    self.store.delete(f"{self.home}/{version + 1:012d}.json")
                    continue
                # Old versions stay for a while, so that a slow writer finds its number taken.
                for old, _ in self.store.list(self.home):
                    if old.endswith(".json") and int(old[:-5]) < version + 1 - KEPT:
                        self.store.delete(f"{self.home}/{old}")
                return new
        raise Conflict("alert rules changed too often at once")

    def create(self, rule: Rule, run: Callable[[str], float]) -> Rule:
        """Adds a rule after running it once, so a rule that cannot run is refused."""
        run(rule.sql)
        self._change(lambda rules: [*rules, rule])
        return rule

    def remove(self, rule_id: str) -> bool:
        had = any(r.id == rule_id for r in self.rules())
        self._change(lambda rules: [r for r in rules if r.id != rule_id])
        return had

    def seed(self, table: str) -> list[Rule]:
        """Two example rules, only where there is none."""
        if self.rules():
            return []
        made = [
            Rule("Share of warnings", f"SELECT 100.0 * count_if(level = 'WARN') / greatest(count(*), 1) AS v FROM {table}", "gt", 20.0),
            Rule("No new records", f"SELECT count(*) AS v FROM {table}", "lt", 1.0, severity="critical"),
        ]
        self._change(lambda rules: rules or made)
        return made

    def evaluate(self, run: Callable[[str], float], now_ms: int, notify: Callable[[dict], None] | None = None) -> list[tuple[Rule, str]]:
        """Runs the enabled rules; one that fails keeps its state. Notices go out after the states are saved."""
        values: dict[str, float] = {}
        for rule in self.rules():
            if rule.enabled:
                try:
                    values[rule.id] = run(rule.sql)
                except Exception:  # noqa: BLE001, S112  a rule must not stop the others
                    continue
        done: list[tuple[Rule, str]] = []

        def edit(rules: list[Rule]) -> list[Rule]:
            done[:] = [step(r, values[r.id], now_ms) if r.id in values else (r, UNCHANGED) for r in rules]
            return [r for r, _ in done]

        self._change(edit)
        for rule, change in done:
            if change != UNCHANGED and notify:
                _tell(notify, {"alert": rule.name, "severity": rule.severity, "state": rule.status.state, "value": rule.status.value, "threshold": rule.threshold, "webhook": rule.webhook})
        return done


def _tell(notify: Callable[[dict], None], notice: dict) -> None:
    """One notice; its failure keeps neither the others nor the saved states back."""
    try:
        notify(notice)
    except OSError:
        return


def runner(engine: Engine) -> Callable[[str], float]:
    """Measures a rule over all files of the engine's table."""

    def run(sql: str) -> float:
        paths = [r["path"] for r in engine.catalog.files().select("path").collect()]
        return single_value(engine.sql(sql, engine.scan(paths)))

    return run


def post(notice: dict, timeout: float = 5.0) -> None:
    """Sends a notice to its webhook, if it has one."""
    import urllib.request

    if notice.get("webhook"):
        body = json.dumps({k: v for k, v in notice.items() if k != "webhook"}).encode()
        urllib.request.urlopen(urllib.request.Request(notice["webhook"], body, {"Content-Type": "application/json"}), timeout=timeout).close()  # noqa: S310

"""The search language: terms joined by AND, then piped commands.

    service:auth status>=500 timeout | last 1h

A term is ``field:value``, ``field op value`` or a word to find in the message. It compiles to column
expressions (the engine's way) and to SQL text (for display and tests), and yields the facts
with which files can be skipped. The clock is an argument.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import millis_ts
from ..model import LOG_COLUMNS, BadQuery

DEFAULT_LIMIT = 200
#: Comparison signs in the order in which a term is searched for them.
SIGNS = ("==", ">=", "<=", "!=", ">", "<", "=")
TEXT_FIELDS = ("service", "message", "trace_id")
UNIT_MILLIS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_COMPARE: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
_RAW_SQL = re.compile(r"\s*(select|with)\b", re.IGNORECASE)


@dataclass(frozen=True)
class Term:
    """``field`` is a column, ``attr:<key>`` or ``text``; ``sign`` is one of =, !=, <, <=, >, >=, like."""

    field: str
    sign: str
    value: str | int


@dataclass(frozen=True)
class Fact:
    """What every result row satisfies, usable against file statistics: kind service, level or text."""

    kind: str
    value: str


@dataclass(frozen=True)
class Search:
    terms: tuple[Term, ...]
    since: tuple[int, ...]

    @property
    def window(self) -> tuple[int, int | None] | None:
        """Earliest time of a result in epoch milliseconds; no upper end, so clock skew hides nothing."""
        return (max(self.since), None) if self.since else None

    @property
    def facts(self) -> tuple[Fact, ...]:
        out = []
        for t in self.terms:
            if t.field in ("service", "level") and t.sign == "=":
                out.append(Fact(t.field, str(t.value)))
            elif t.field == "text" and not set("%_\\") & set(str(t.value)):
                out.append(Fact("text", str(t.value)))
        return tuple(out)

    def condition(self) -> Column:
        parts = [_column(t) for t in self.terms] + [F.col("ts") >= millis_ts(F.lit(s)) for s in self.since]
        return reduce(operator.and_, parts) if parts else F.lit(True)

    def apply(self, logs: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
        out = logs.where(self.condition()).select(*LOG_COLUMNS).orderBy(F.desc("ts"))
        return out if limit is None else out.limit(limit)

    def sql(self, table: str, limit: int = DEFAULT_LIMIT) -> str:
        parts = [_text(t) for t in self.terms] + [f"ts >= to_timestamp_millis({s})" for s in self.since]
        where = f" WHERE {' AND '.join(parts)}" if parts else ""
        return f"SELECT {', '.join(LOG_COLUMNS)} FROM {table}{where} ORDER BY ts DESC LIMIT {limit}"


def is_sql(query: str) -> bool:
    """Whether the text is SQL: its first word is SELECT or WITH."""
    return _RAW_SQL.match(query) is not None


def duration_millis(text: str) -> int:
    found = re.fullmatch(r"(\d+)([smhd])", text)
    if not found:
        raise BadQuery(f"bad duration {text!r}; use a number and one of s, m, h, d")
    return int(found[1]) * UNIT_MILLIS[found[2]]


def parse(query: str, now_ms: int) -> Search:
    head, *commands = query.split("|")
    glued = re.sub(r"\s*(==|>=|<=|!=|>|<|=)\s*", r"\1", head)
    terms = tuple(_term(word) for word in glued.split())
    since = []
    for command in commands:
        words = command.split()
        if len(words) != 2 or words[0] != "last":
            raise BadQuery(f"unknown command {command.strip()!r}; the only one is: last <duration>")
        since.append(max(now_ms - duration_millis(words[1]), -(1 << 62)))
    return Search(terms, tuple(since))


def _term(word: str) -> Term:
    for sign in SIGNS:
        if sign in word:
            key, value = word.split(sign, 1)
            return _field(word, key, "=" if sign == "==" else sign, value)
    if ":" in word:
        key, value = word.split(":", 1)
        return _field(word, key, "=", value)
    return Term("text", "like", word)


def _field(word: str, key: str, sign: str, value: str) -> Term:
    if not key or not value:
        raise BadQuery(f"malformed term {word!r}: a field, a sign and a value are needed")
    if key == "status":
        if not re.fullmatch(r"[+-]?\d+", value):
            raise BadQuery(f"status is a number, not {value!r}")
        return Term(key, sign, int(value))
    if key == "level":
        return Term(key, sign, value.upper())
    if key in TEXT_FIELDS:
        return Term(key, sign, value)
    if sign != "=":
        raise BadQuery(f"{word!r}: attribute {key!r} can only be matched with = or :")
    return Term(f"attr:{key}", "like", value)


def _pattern(term: Term) -> str:
    """LIKE pattern; % and _ of the user stay wildcards, a backslash is literal."""
    value = str(term.value).replace("\\", "\\\\")
    if term.field == "text":
        return f"%{value}%"
    key = term.field.removeprefix("attr:").replace("\\", "\\\\")
    return f'%"{key}":"{value}"%'


def _column(term: Term) -> Column:
    if term.field == "text":
        return F.col("message").ilike(_pattern(term))
    if term.sign == "like":
        return F.col("attrs_json").like(_pattern(term))
    return _COMPARE[term.sign](F.col(term.field), F.lit(term.value))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _text(term: Term) -> str:
    if term.field == "text":
        return f"message ILIKE {_quoted(_pattern(term))}"
    if term.sign == "like":
        return f"attrs_json LIKE {_quoted(_pattern(term))}"
    return f"{term.field} {term.sign} {term.value if isinstance(term.value, int) else _quoted(term.value)}"

"""Expressions that bring records into the storage schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Routing

#: Spellings of each level on the wire, lower case.
LEVEL_WORDS = {"ERROR": ("error", "err", "fatal", "critical"), "WARN": ("warn", "warning"), "DEBUG": ("debug", "trace"), "INFO": ("info", "notice", "information")}
#: Attributes that may carry a status, in order of preference.
STATUS_KEYS = ("http.status_code", "http.response.status_code", "status_code", "status")


def normal_level(level: Column) -> Column:
    """A known spelling's level, else INFO; null counts as INFO."""
    word, out = F.lower(F.trim(level)), None
    for name, words in LEVEL_WORDS.items():
        out = F.when(word.isin(*words), name) if out is None else out.when(word.isin(*words), name)
    return out.otherwise("INFO")


def severity_level(text: Column, number: Column) -> Column:
    """Severity text if it is a known spelling, else the number's range, else INFO."""
    word = F.lower(F.trim(text))
    known = [w for words in LEVEL_WORDS.values() for w in words]
    return (
        F.when(word.isin(*known), normal_level(text))
        .when(number.between(1, 8), "DEBUG")
        .when(number.between(9, 12), "INFO")
        .when(number.between(13, 16), "WARN")
        .when(number >= 17, "ERROR")
        .otherwise("INFO")
    )


def tier_of(level: Column, routing: Routing | None = None) -> Column:
    r = routing or Routing()
    return F.when(level == "ERROR", r.error).when(level == "WARN", r.warn).when(level == "DEBUG", r.debug).otherwise(r.info)


def millis_ts(millis: Column) -> Column:
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def ts_millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def canonical_attrs(attrs: Column) -> Column:
    """Compact JSON with sorted keys, null for an empty or null map. Null values are dropped."""
    full = F.map_filter(attrs, lambda _, v: v.isNotNull())
    return F.when(F.coalesce(F.cardinality(full), F.lit(0)) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(full)))))


def approx_bytes(message: Column, service: Column, attrs_json: Column) -> Column:
    return F.octet_length(message) + F.octet_length(service) + F.coalesce(F.octet_length(attrs_json), F.lit(0)) + F.lit(64)

"""Settings, with the engine's defaults, from TOML or code. Immutable."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

ENV_PATH, DEFAULT_PATH = "LOGLAKE_CONFIG", "config/loglake.toml"


@dataclass(frozen=True)
class Storage:
    backend: str = "local"
    root: str = "data"
    bucket: str = ""
    region: str = ""
    endpoint: str = ""
    prefix: str = ""


@dataclass(frozen=True)
class Query:
    scan_mib_per_core: float = 250.0
    cores: int = 4
    max_result_rows: int = 1_000_000
    max_result_bytes: int = 256 << 20


@dataclass(frozen=True)
class Routing:
    error: str = "hot"
    warn: str = "warm"
    info: str = "warm"
    debug: str = "cold"

    def tier(self, level: str) -> str:
        return {"ERROR": self.error, "WARN": self.warn, "INFO": self.info, "DEBUG": self.debug}[level]


@dataclass(frozen=True)
class Lifecycle:
    warm_after_days: int = 3
    cold_after_days: int = 30
    expire_after_days: int = 400


@dataclass(frozen=True)
class Auth:
    enabled: bool = False
    api_token: str = ""


@dataclass(frozen=True)
class Ingest:
    max_body_bytes: int = 16 << 20
    max_in_flight: int = 32
    roll_rows: int = 100_000
    roll_bytes: int = 128 << 20
    row_group_rows: int = 131_072


@dataclass(frozen=True)
class Compaction:
    enabled: bool = True
    target_bytes: int = 256 << 20
    trigger_files: int = 16
    files_per_pass: int = 128
    every_seconds: int = 300


@dataclass(frozen=True)
class Config:
    storage: Storage = field(default_factory=Storage)
    query: Query = field(default_factory=Query)
    routing: Routing = field(default_factory=Routing)
    lifecycle: Lifecycle = field(default_factory=Lifecycle)
    auth: Auth = field(default_factory=Auth)
    ingest: Ingest = field(default_factory=Ingest)
    compaction: Compaction = field(default_factory=Compaction)


def from_dict(values: dict) -> Config:
    """A configuration from nested tables; an unknown table or key is an error."""
    base = Config()
    for name, table in values.items():
        section = getattr(base, name, None)
        if not is_dataclass(section):
            raise ValueError(f"unknown configuration table: {name}")
        known = {f.name for f in fields(section)}
        if extra := set(table) - known:
            raise ValueError(f"unknown keys in [{name}]: {', '.join(sorted(extra))}")
        base = replace(base, **{name: replace(section, **table)})
    for level in ("error", "warn", "info", "debug"):
        if getattr(base.routing, level) not in ("hot", "warm", "cold"):
            raise ValueError(f"routing.{level} is no tier")
    return base


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Config:
    """The given file, else the one the environment names, else the default path if it exists, else defaults."""
    environ = os.environ if environ is None else environ
    chosen = path or environ.get(ENV_PATH)
    if chosen is None and Path(DEFAULT_PATH).is_file():
        chosen = DEFAULT_PATH
    config = from_dict(tomllib.loads(Path(chosen).read_text())) if chosen else Config()
    if token := environ.get("LOGLAKE_API_TOKEN"):
        config = replace(config, auth=replace(config.auth, enabled=True, api_token=token))
    return config

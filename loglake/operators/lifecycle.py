"""Lifecycle rules of object stores, from the configuration."""

from __future__ import annotations

import json

from ..config import Lifecycle


def policy(table: str, config: Lifecycle | None = None) -> dict:
    """One rule for the table's prefix: two transitions, then expiry. Days must rise."""
    c = config or Lifecycle()
    if not 0 < c.warm_after_days < c.cold_after_days < c.expire_after_days:
        raise ValueError("lifecycle days must be positive and rise from warm to cold to expiry")
    return {
        "Rules": [
            {
                "ID": f"{table}-tiering",
                "Status": "Enabled",
                "Filter": {"Prefix": f"{table}/"},
                "Transitions": [{"Days": c.warm_after_days, "StorageClass": "GLACIER_IR"}, {"Days": c.cold_after_days, "StorageClass": "GLACIER"}],
                "Expiration": {"Days": c.expire_after_days},
            }
        ]
    }


def to_json(table: str, config: Lifecycle | None = None) -> str:
    return json.dumps(policy(table, config), indent=2)


def class_at_age(days: float, config: Lifecycle | None = None) -> str | None:
    """The storage class of an object so many days old; none once it expired."""
    c = config or Lifecycle()
    if days >= c.expire_after_days:
        return None
    return "GlacierFlexible" if days >= c.cold_after_days else "GlacierInstant" if days >= c.warm_after_days else "Standard"

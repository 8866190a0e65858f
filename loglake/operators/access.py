"""Tokens and roles."""

from __future__ import annotations

import hashlib
import json
import secrets
from dataclasses import asdict, dataclass, replace

from ..config import Auth
from ..model import Conflict, Forbidden
from .files import Store

ROLES = ("readonly", "readwrite", "admin")
#: The least role for each operation.
NEEDS = {"query": "readonly", "estimate": "readonly", "metrics": "readonly", "tail": "readonly", "storage": "readonly", "cost": "readonly", "pipelines": "readonly", "settings": "readonly", "alerts": "readonly"}
NEEDS |= {"ingest": "readwrite", "ingest_otlp": "readwrite", "create_alert": "readwrite", "remove_alert": "readwrite", "compact": "readwrite"}
NEEDS |= {"audit": "admin", "tokens": "admin", "issue_token": "admin", "revoke_token": "admin"}


@dataclass(frozen=True)
class Token:
    id: str
    name: str
    role: str
    hash: str
    created_ms: int
    revoked: bool = False


def digest(secret: str) -> str:
    return hashlib.sha256(secret.encode()).hexdigest()


def allows(role: str, operation: str) -> bool:
    return role in ROLES and ROLES.index(role) >= ROLES.index(NEEDS[operation])


class Tokens:
    """Token hashes in versions that are created exclusively; a secret is shown once and never stored."""

    HOME, ATTEMPTS = "_auth", 16

    def __init__(self, store: Store) -> None:
        self.store = store

    def _latest(self) -> tuple[int, list[Token]]:
        known = [n for n, _ in self.store.list(self.HOME) if n.endswith(".json")]
        if not known:
            return 0, []
        return int(known[-1][:-5]), [Token(**t) for t in json.loads(self.store.read(f"{self.HOME}/{known[-1]}"))]

    def list(self) -> list[Token]:
        return self._latest()[1]

    def _change(self, edit) -> None:
        for _ in range(self.ATTEMPTS):
            version, tokens = self._latest()
            if self.store.create(f"{self.HOME}/{version + 1:012d}.json", json.dumps([asdict(t) for t in edit(tokens)]).encode()):
                return
        raise Conflict("tokens changed too often at once")

    def issue(self, name: str, role: str, now_ms: int) -> tuple[Token, str]:
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        secret = secrets.token_urlsafe(32)
        token = Token(secrets.token_hex(8), name, role, digest(secret), now_ms)
        self._change(lambda old: [*old, token])
        return token, secret

    def revoke(self, token_id: str) -> bool:
        had = any(t.id == token_id and not t.revoked for t in self.list())
        self._change(lambda old: [replace(t, revoked=True) if t.id == token_id else t for t in old])
        return had

    def role_of(self, secret: str) -> str | None:
        wanted = digest(secret)
        return next((t.role for t in self.list() if not t.revoked and secrets.compare_digest(t.hash, wanted)), None)

    def require(self, secret: str | None, operation: str) -> str:
        """The role of a secret that may do the operation; raises otherwise."""
        role = self.role_of(secret) if secret else None
        if role is None or not allows(role, operation):
            raise Forbidden(f"{operation} needs the role {NEEDS[operation]}")
        return role


class Denied(Forbidden):
    """No secret, or none that is valid."""

    status = 401


class Sessions:
    """Checks secrets against a copy of the tokens, read again by :meth:`refresh` and not on each request.

    With authentication off everything is allowed; the configured secret is always an administrator's.
    """

    def __init__(self, tokens: Tokens, auth: Auth) -> None:
        self.tokens, self.auth = tokens, auth
        self._known: dict[str, Token] = {}
        if auth.enabled:
            self.refresh()

    def refresh(self) -> None:
        self._known = {t.hash: t for t in self.tokens.list() if not t.revoked}

    def require(self, secret: str | None, operation: str) -> str:
        """Who may do the operation with this secret; raises otherwise."""
        if not self.auth.enabled:
            return "anonymous"
        if not secret:
            raise Denied("a token is expected")
        mark = digest(secret)
        if self.auth.api_token and secrets.compare_digest(mark, digest(self.auth.api_token)):
            return "configured-admin"
        token = self._known.get(mark)
        if token is None:
            raise Denied("the token is unknown or revoked")
        if not allows(token.role, operation):
            raise Forbidden(f"{operation} needs the role {NEEDS[operation]}, the token has {token.role}")
        return token.name

"""Signed cursors: where a page ended, with the revision that was read and the request that it belongs to."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Sequence

from lattica.schema import EDGE_KINDS, VerbError

VERSION, MOST = "v1", 1 << 20


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def _raw(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


class Codec:
    """``v1.<payload>.<signature>``, both in URL-safe base64; a signature holds in its domain, the operation, only."""

    def __init__(self, key: bytes, domain: str) -> None:
        self.key, self.domain = key, domain.encode()

    def _sign(self, payload: bytes) -> bytes:
        return hmac.new(self.key, len(self.domain).to_bytes(4, "big") + self.domain + payload, hashlib.sha256).digest()

    def encode(self, payload: dict) -> str:
        raw = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
        return f"{VERSION}.{_b64(raw)}.{_b64(self._sign(raw))}"

    def decode(self, text: str) -> dict:
        """The payload of a cursor of this key and domain; it is parsed only after its signature has been checked."""
        version, _, rest = text.partition(".") if len(text) <= MOST else ("", "", "")
        payload, dot, signature = rest.partition(".")
        try:
            raw, given = _raw(payload), _raw(signature)
        except ValueError:
            raw = given = b""
        if version != VERSION or not dot or not hmac.compare_digest(given, self._sign(raw)):
            raise VerbError("invalid_cursor", "the cursor is damaged or of another key")
        return json.loads(raw)


def shape(node: str, direction: str = "both", kinds: Sequence[str] | None = None, depth: int = 1, since: int | None = None) -> dict:
    """What a request asks for, however it is written: kinds in any order and repeated, all of them or none named, are the same."""
    chosen = sorted(set(kinds)) if kinds is not None else None
    return {"node": node, "direction": direction, "kinds": None if chosen == sorted(EDGE_KINDS) else chosen, "depth": depth, "since": since}


def searched(query: str, kinds: Sequence[str] | None, repos: Sequence[str] | None) -> dict:
    """What a search asks for; kinds and repositories in any order."""
    return {"query": query, "kinds": sorted(set(kinds)) if kinds is not None else None, "repos": sorted(set(repos)) if repos is not None else None}


def agree(cursor: dict, request: dict) -> None:
    """A cursor goes on with its own request only; what may differ is the size of the page."""
    if cursor.get("request") != request:
        raise VerbError("invalid_cursor", "the cursor belongs to another request")

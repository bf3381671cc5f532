"""URLs and messages without the values that could be secret."""

from __future__ import annotations

import re
from dataclasses import replace

from .text import bounded_bytes, trim
from .urls import UrlError, encode_query, parse, query_pairs

# Query keys that hold secrets, whole and in part, after lower-casing and dropping _ - . and spaces.
SENSITIVE_KEYS = ["token", "accesstoken", "apikey", "key", "secret", "clientsecret", "privatekey", "password", "signature", "sig", "xamzsignature", "xgoogsignature", "code", "authorization", "auth", "authtoken", "jwt", "idtoken", "refreshtoken", "session", "sessionid", "xamzcredential", "xamzsecuritytoken"]
SENSITIVE_PARTS = ["token", "secret", "signature", "credential", "password", "passwd", "privatekey", "apikey", "accesskey", "session", "authorization", "jwt"]
_URL_IN_TEXT = re.compile(r"https?://[^\s\"'<>]+", re.A)


def sensitive_key(key: str) -> bool:
    k = re.sub(r"[_\-. ]", "", trim(key.lower()))
    return k in SENSITIVE_KEYS or any(p in k for p in SENSITIVE_PARTS)


def redact_url(raw: str) -> str:
    """The URL with placeholders for all query values, and without user and fragment."""
    raw = trim(raw)
    if not raw:
        return ""
    try:
        u = parse(raw)
    except UrlError:
        return "[invalid-url]"
    pairs = {k: ["[REDACTED]" if sensitive_key(k) else "[VALUE]"] for k in query_pairs(u.query)}
    return str(replace(u, query=encode_query(pairs) or None, user=None, fragment=""))


def _redact_match(m: re.Match) -> str:
    core = m[0].rstrip(".,;:)]}")
    return redact_url(core) + m[0][len(core) :]


def redact_text(raw: str) -> str:
    return _URL_IN_TEXT.sub(_redact_match, raw)


def sanitize_error(raw: str) -> str:
    return bounded_bytes(redact_text(raw))

"""robots.txt rules: one parse per policy, path matching piece by piece between stars, in linear steps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .text import trim
from .urls import Url

MAX_POLICY_BYTES = 512 * 1024
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})|([\x80-\xff])", re.S)
_UNRESERVED = re.compile(rb"[A-Za-z0-9\-._~]")


class PolicyError(ValueError):
    """The policy can't be used."""


def octets(s: str) -> str:
    """Escapes of unreserved ASCII decoded, other escapes in capitals, bytes beyond ASCII escaped."""

    def one(m: re.Match) -> bytes:
        b = bytes([int(m[1], 16)]) if m[1] else m[2]
        return b if m[1] and _UNRESERVED.fullmatch(b) else b"%%%02X" % b[0]

    return _ESCAPE.sub(one, s.encode("utf-8", "surrogateescape")).decode("ascii")


@dataclass(frozen=True)
class Rule:
    allow: bool
    pattern: str
    specificity: int
    anchored: bool

    @property
    def pieces(self) -> list[str]:
        """What stands between the stars."""
        return self.pattern.split("*")

    def matches(self, path: str) -> bool:
        """Each piece is taken where it first fits after the one before, which leaves the most for the rest."""
        first, *rest = self.pieces
        if not rest:
            return path == first if self.anchored else path.startswith(first)
        if not path.startswith(first):
            return False
        last, at = rest.pop() if self.anchored else "", len(first)
        for piece in rest:
            found = path.find(piece, at)
            if found < 0:
                return False
            at = found + len(piece)
        return len(path) - len(last) >= at and path.endswith(last)


def specificity(pattern: str) -> int:
    """Bytes of the pattern without a closing $ and stars; an escape is one."""
    return len(re.sub(rb"%[0-9A-Fa-f]{2}", b"x", pattern.removesuffix("$").encode("utf-8", "surrogateescape")).replace(b"*", b""))


def _records(content: str):
    """(key, value) of each line that has both."""
    for line in re.split(r"\r\n|\r|\n", content):
        key, colon, value = trim(line.partition("#")[0]).partition(":")
        if colon:
            yield trim(key).lower(), trim(value)


def agent_matches(agent: str, user_agent: str) -> bool:
    product = trim(user_agent.partition("/")[0])
    return agent == "*" or (agent != "" and agent.casefold() == product.casefold())


def rules_for(content: str, user_agent: str) -> list[Rule]:
    """Rules of the group whose agent matches at greatest length; groups that tie are merged. Raises PolicyError."""
    if len(content.encode("utf-8", "surrogateescape")) > MAX_POLICY_BYTES:
        raise PolicyError(f"robots.txt exceeds policy limit of {MAX_POLICY_BYTES} bytes")
    groups: list[tuple[list[str], list[Rule]]] = []
    open_ = False  # whether a user-agent line joins the last group
    for key, value in _records(content):
        if key == "user-agent":
            if not open_:
                groups.append(([], []))
                open_ = True
            groups[-1][0].append(value.lower())
        elif key in ("allow", "disallow") and groups:
            open_ = False
            if value:
                groups[-1][1].append(Rule(key == "allow", octets(value.removesuffix("$")), specificity(value), value.endswith("$")))
    reach = [max((len(a.encode()) for a in agents if agent_matches(a, user_agent)), default=-1) for agents, _ in groups]
    best = max(reach, default=-1)
    return [r for n, (_, rules) in zip(reach, groups, strict=True) if n == best >= 0 for r in rules]


def request_path(u: Url) -> str:
    return octets((u.escaped_path() or "/") + (f"?{u.query}" if u.query else ""))


class Policy:
    def __init__(self, rules: list[Rule]) -> None:
        # the deciding rule comes first: most specific, then allowing
        self.rules = sorted(rules, key=lambda r: (-r.specificity, not r.allow))

    def allows(self, path: str) -> bool:
        path = octets(path)
        if path.partition("?")[0] == "/robots.txt":
            return True
        return next((r.allow for r in self.rules if r.matches(path)), True)


def path_allowed(content: str, user_agent: str, path: str) -> bool:
    try:
        return Policy(rules_for(content, user_agent)).allows(path)
    except PolicyError:
        return False


def status_outcome(status: int | None) -> str:
    """What a robots.txt response means: parse its body, allow all, or unavailable."""
    if status is None:
        return "unavailable"
    return "parse" if 200 <= status < 300 else "allow_all" if 400 <= status < 500 else "unavailable"

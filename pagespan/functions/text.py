"""One white-space class, bounded strings and word counts."""

from __future__ import annotations

import re

# The characters of the Unicode White_Space property.
SPACE = "\t\n\v\f\r \x85\xa0                　"
SPACE_CLASS = f"[{SPACE}]"
_RUN = re.compile(f"[^{SPACE}]+")

# Storage bounds in code points, and status limits.
BOUNDS = {"url": 2048, "title": 500, "description": 4000, "h1": 1000, "twitter_card": 100, "robots": 200}
TITLE_LIMITS, DESCRIPTION_LIMITS = (40, 65), (120, 170)
ERROR_BYTES = 1000


def trim(s: str) -> str:
    return s.strip(SPACE)


def bounded(s: str, most: int) -> tuple[str, bool, int]:
    """First `most` code points; whether some were cut; the whole length if so, else 0."""
    return (s, False, 0) if len(s) <= most else (s[:most], True, len(s))


def rebounded(s: str, most: int, cut: bool, length: int) -> tuple[str, bool, int]:
    """bounded() of a value that may have been cut before: an earlier cut is kept, with the greater length."""
    out, now, measured = bounded(s, most)
    return (out, True, max(length, measured)) if cut else (out, now, measured)


def bounded_bytes(s: str, most: int = ERROR_BYTES) -> str:
    """At most `most` UTF-8 bytes, cut between code points, with an ellipsis if cut."""
    raw = s.encode("utf-8", "surrogatepass")
    return s if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."


def words(parts) -> int:
    """Runs of solid characters in the parts joined without a gap."""
    return sum(1 for _ in _RUN.finditer("".join(parts)))


def length_status(n: int, limits: tuple[int, int]) -> str:
    if n == 0:
        return "Missing"
    return "Too Short" if n < limits[0] else "Too Long" if n > limits[1] else "OK"

"""Tells when a literal pattern looks like a regular expression."""

from __future__ import annotations

import re

#: What precedes a character that no odd number of backslashes escapes.
_FREE = r"(?<!\\)(?:\\\\)*"
#: Detectors in order; the first that finds something names it.
DETECTORS = [
    _FREE + r"(\\\|)",
    "group",
    _FREE + r"(\\[dDwWsSbB])",
    _FREE + r"(\\[()])",
    "class",
    r"(\{\d+(?:,\d*)?\})",
    r"(\(\?:|\(\?=|\(\?!|\(\?<=|\(\?<!)",
    _FREE + r"(\\[nt])",
]


def _alternation(pattern: str) -> str | None:
    """The first group that closes with a bar since its last bracket, or some of it."""
    depth, bar, escaped = 0, False, False
    for i, c in enumerate(pattern):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == "(":
            depth += 1
        elif c == "|" and depth:
            bar = True
        elif c == ")":
            if bar and depth:
                return pattern[min(max(pattern.rfind("(", 0, i), 0), max(i - 20, 0)) : i + 1]
            depth, bar = max(depth - 1, 0), False
    return None


def _range(pattern: str) -> str | None:
    """The first bracket expression with a range of letters or digits."""
    for m in re.finditer(r"\\.|(\[[\^\]]?([^\]]*)(\]?))", pattern, re.S):
        if m[1] and re.search(r"[0-9A-Za-z]-[^\]]", m[2]):
            return m[1]
    return None


def detect_regex(pattern: str) -> str | None:
    """The piece of pattern that looks like a regular expression, or None."""
    special = {"group": _alternation, "class": _range}
    for detector in DETECTORS:
        if detector in special:
            found = special[detector](pattern)
        else:
            m = re.search(detector, pattern)
            found = m[1] if m else None
        if found:
            return found
    return None


def detect_regex_hint(pattern: str) -> str | None:
    """The message for such a pattern, or None."""
    found = detect_regex(pattern)
    return found and f"hint: `{found}` is read as plain text; -e makes the pattern a regular expression"

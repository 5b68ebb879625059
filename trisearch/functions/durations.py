"""Durations of --since: 1h, 30m, 2d, 1w or 3.commits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import InvalidArgument

#: The units.
UNITS = {"h": ("hour", 3600), "m": ("minute", 60), "d": ("day", 86400), "w": ("week", 604800)}


@dataclass(frozen=True)
class Since:
    """The last commits, or what changed within seconds; phrase is how git is told."""

    commits: int | None = None
    seconds: int | None = None
    phrase: str | None = None


def parse_since(text: str) -> Since:
    number = lambda s: int(s) if re.fullmatch(r"\+?[0-9]+", s, re.A) and int(s) < 2**32 else None
    if text.endswith(".commits"):
        n = number(text.removesuffix(".commits"))
        if n is None:
            raise InvalidArgument(f"not a number of commits: {text.removesuffix('.commits')}")
        return Since(commits=n)
    if text[-1:] not in UNITS:
        raise InvalidArgument(f"{text} is no span of time: give a number and h, m, d, w or .commits")
    n = number(text[:-1])
    if n is None:
        raise InvalidArgument(f"not a number: {text[:-1]}")
    unit, seconds = UNITS[text[-1]]
    return Since(seconds=n * seconds, phrase=f"{n} {unit}{'' if n == 1 else 's'} ago")

"""Column functions on texts: lines, case, token estimates, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else."""
    return F.translate(text, UPPER, LOWER)


def segments(content: Column) -> Column:
    """All pieces between line feeds; one more than there are line feeds."""
    return F.split(content, "\n", -1)


def raw_lines(content: Column) -> Column:
    """Lines as literal search sees them: carriage returns stay, and what follows
    the last line feed is a line only if it isn't empty. An empty text has one empty line."""
    parts = segments(content)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def text_lines(content: Column) -> Column:
    """Lines as regular expressions and context see them: a carriage return before a
    line feed belongs to the line's end. An empty text has no line."""
    parts = segments(content)
    last = F.element_at(parts, -1)
    ended = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda s: F.regexp_replace(s, r"\r\z", ""))
    return F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))


def shown(line: Column) -> Column:
    """A line, or a mark in its place where its bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(line), line).otherwise(F.lit("<binary>"))


def ascii_bytes(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")).cast("long")


def token_estimate(ascii_count: Column, other_bytes: Column) -> Column:
    """Four ASCII bytes or two others to a token, and one more."""
    return F.floor(ascii_count / 4) + F.floor(other_bytes / 2) + 1


def contains_any(path: Column, needles: list[str]) -> Column:
    """Whether a path has one of the non-empty substrings."""
    found = F.lit(False)
    for n in needles:
        if n:
            found = found | F.contains(path, F.lit(n))
    return found

"""The three matchers: from files (path, content) to matching lines.

Each first drops whole files by one test of the content, then tests lines. What
comes out is (file, line_number, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, raw_lines, segments, shown, text_lines
from ..plans import regex


def _numbered(files: DataFrame, lines: Column) -> DataFrame:
    return files.select(F.col("path").alias("file"), F.posexplode(lines).alias("at", "line")).select("file", (F.col("at") + 1).cast("int").alias("line_number"), "line")


def literal(files: DataFrame, pattern: str) -> DataFrame:
    """Lines in which an occurrence of pattern starts, in whatever case it is given.
    A pattern may go over line ends."""
    gated = files.where(F.contains("content", F.lit(pattern)))
    first, *rest = pattern.split("\n")
    if not rest:
        return _numbered(gated, raw_lines(F.col("content"))).where(F.contains("line", F.lit(pattern))).withColumn("line", shown(F.col("line")))
    parts = gated.select("path", segments(F.col("content")).alias("parts"))
    piece = lambda i, j: F.get(F.col("parts"), i + j)

    def starts(i: Column) -> Column:
        ok = piece(i, 0).endswith(first)
        for j, p in enumerate(rest[:-1], 1):
            ok = ok & (piece(i, j) == p)
        return ok & F.coalesce(piece(i, len(rest)).startswith(rest[-1]), F.lit(False))

    hits = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), starts)
    found = parts.select(F.col("path").alias("file"), "parts", F.explode(hits).alias("i"))
    return found.select("file", (F.col("i") + 1).cast("int").alias("line_number"), shown(F.get("parts", F.col("i"))).alias("line"))


def literal_ignoring_case(files: DataFrame, pattern: str) -> DataFrame:
    """Lines that hold pattern, which is lowered, once their own ASCII letters are."""
    wanted = F.lit(pattern.lower())
    gated = files.where(F.contains(ascii_lower(F.col("content")), wanted) & (F.col("content") != ""))
    return _numbered(gated, raw_lines(F.col("content"))).where(F.contains(ascii_lower(F.col("line")), wanted)).withColumn("line", shown(F.col("line")))


def regular(files: DataFrame, pattern: str, ignore_case: bool = False, line_anchors: bool = False) -> DataFrame:
    """Lines that match, of files that match as a whole. As anchors stand for the
    ends of the text, the first test drops files whose lines alone match them;
    line_anchors leaves that test out."""
    java = regex.to_java(pattern, ignore_case)
    content = F.make_valid_utf8("content")
    gated = files if line_anchors else files.where(F.rlike(content, F.lit(java)))
    return _numbered(gated, text_lines(content)).where(F.rlike("line", F.lit(java)))


def find(files: DataFrame, pattern: str, ignore_case: bool = False, is_regex: bool = False) -> DataFrame:
    if is_regex:
        return regular(files, pattern, ignore_case)
    return literal_ignoring_case(files, pattern) if ignore_case else literal(files, pattern)


def all_lines(files: DataFrame) -> DataFrame:
    """Every line (file, line_number, line), as context shows them."""
    return _numbered(files, text_lines(F.make_valid_utf8("content")))

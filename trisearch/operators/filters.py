"""Filters on paths, limits, and the join of search results with changes."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filetypes import extension, extensions_for_type
from ..functions.text import contains_any
from ..plans.regex import glob_to_java

log = logging.getLogger("trisearch")


def of_type(path: Column, file_type: str, quiet: bool = False) -> Column:
    """Whether a path's extension is of a type; an unknown type lets all pass."""
    found = extensions_for_type(file_type)
    if found is None:
        if not quiet:
            log.warning("unknown file type '%s', showing all results", file_type)
        return F.lit(True)
    return extension(path).isin(found)


def by_name(paths: DataFrame, pattern: str) -> DataFrame:
    """Rows whose path matches: a glob over the whole path if it has * ? or [, else a
    substring in any case."""
    if any(c in pattern for c in "*?["):
        return paths.where(F.rlike("path", F.lit(glob_to_java(pattern))))
    return paths.where(F.contains(F.lower("path"), F.lit(pattern.lower())))


def without(rows: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    return rows.where(~contains_any(F.col(column), excluded)) if any(excluded) else rows


def ordered(results: DataFrame, max_count: int | None = None) -> DataFrame:
    """By file and line, and of these the first: a top-k, not a sort, where there is a limit."""
    results = results.orderBy("file", "line_number")
    return results if max_count is None else results.limit(max_count)


def merge_fresh(indexed: DataFrame, direct: DataFrame, changed: DataFrame) -> DataFrame:
    """Results of an index without those of changed files (path), and in their
    place the results of scanning these; each line once."""
    kept = indexed.join(changed.select(F.col("path").alias("file")).distinct(), "file", "left_anti")
    return kept.unionByName(direct).dropDuplicates(["file", "line_number"])

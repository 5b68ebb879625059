"""Output formats, as relations of text blocks in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filetypes import language
from ..functions.text import ascii_bytes, token_estimate
from . import context


def shown_path(path: Column, root: str | None = None) -> Column:
    return path if root is None else F.concat(F.lit(root.rstrip("/") + "/"), path)


def default_lines(results: DataFrame, root: str | None = None) -> DataFrame:
    """(file, line_number, text): file:line_number:line."""
    return results.select("file", "line_number", F.concat_ws(":", shown_path(F.col("file"), root), "line_number", "line").alias("text"))


def json_rows(results: DataFrame, root: str | None = None) -> DataFrame:
    """(file, line_number, text): an object for each result."""
    return results.select("file", "line_number", F.to_json(F.struct(shown_path(F.col("file"), root).alias("file"), "line_number", "line")).alias("text"))


def count_per_file(results: DataFrame) -> DataFrame:
    return results.groupBy("file").agg(F.count("*").alias("n"))


def files_only(results: DataFrame) -> DataFrame:
    return results.select("file").distinct()


def summary(results: DataFrame, max_results: int | None = None) -> DataFrame:
    """One row: matches, files, whether the limit was reached, and the header that tools show."""
    n = results.agg(F.count("*").alias("matches"), F.count_distinct("file").alias("files"))
    limited = F.lit(False) if max_results is None else F.col("matches") == max_results
    head = F.when(limited, F.format_string(f"Found %d+ matches in %d files (limited to {max_results})", "matches", "files")).otherwise(F.format_string("Found %d matches in %d files", "matches", "files"))
    return n.select("matches", "files", limited.alias("limited"), head.alias("header"))


def context_blocks(results: DataFrame, files: DataFrame, lines: int, root: str | None = None) -> DataFrame:
    """(file, island, text): blocks of context, with : at matches and - elsewhere; trailing white space goes."""
    mark = F.when(F.col("is_match"), ":").otherwise("-")
    row = F.concat(shown_path(F.col("file"), root), mark, F.col("line_number").cast("string"), mark, "line")
    rows = context.lines(results, files, lines).select("file", "island", F.struct("line_number", row.alias("row")).alias("r"))
    # A block has the lines around some matches of a file.
    blocks = rows.groupBy("file", "island").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias("rows"))
    return blocks.select("file", "island", F.regexp_replace(F.array_join("rows", "\n"), r"\s+\z", "").alias("text"))


def markdown_blocks(results: DataFrame, files: DataFrame, lines: int, root: str | None = None) -> DataFrame:
    """(file, island, text): a heading and a fenced block for each range."""
    rows = context.lines(results, files, lines).select("file", "island", F.struct("line_number", "line").alias("r"))
    blocks = rows.groupBy("file", "island").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    first, last = F.element_at("rows", 1)["line_number"], F.element_at("rows", -1)["line_number"]
    place = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit("\n"))), "")
    text = F.concat(F.lit("## "), shown_path(F.col("file"), root), F.lit(":"), place, F.lit("\n\n```"), language(F.col("file")), F.lit("\n"), body, F.lit("```\n"))
    return blocks.select("file", "island", text.alias("text"))


def within_budget(blocks: DataFrame, results: DataFrame, max_tokens: int) -> DataFrame:
    """(file, text, estimate, more_matches, more_files) of the files that are shown: after
    each file the whole output so far is estimated, and no more follow once it reaches max_tokens.
    more_*: what is left out after a file. Runs over the files with matches, in order."""
    joined = blocks.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("island", "text"))), lambda b: b["text"]), "\n").alias("text"))
    counted = joined.join(results.groupBy("file").agg(F.count("*").alias("n")), "file")
    order = Window.orderBy("file")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sized = counted.withColumns({"plain": ascii_bytes(F.col("text")) + F.when(F.row_number().over(order) > 1, 1).otherwise(0), "other": F.octet_length("text").cast("long") - ascii_bytes(F.col("text"))})
    sums = sized.withColumn("estimate", token_estimate(F.sum("plain").over(so_far), F.sum("other").over(so_far)))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    marked = sums.withColumns({"before": F.lag("estimate").over(order), "more_matches": F.coalesce(F.sum("n").over(after), F.lit(0)), "more_files": F.count("file").over(after)})
    return marked.where(F.coalesce(F.col("before"), F.lit(0)) < max_tokens).select("file", "text", "estimate", "more_matches", "more_files")


def numbered(lines: DataFrame) -> DataFrame:
    """(line_number, text) of lines of a file, with the number in four columns."""
    return lines.select("line_number", F.concat(F.lpad(F.col("line_number").cast("string"), F.greatest(F.lit(4), F.length(F.col("line_number").cast("string"))), F.lit(" ")), F.lit(" | "), "line").alias("text"))

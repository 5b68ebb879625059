"""Context around matches: ranges that overlap or touch are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_lines
from .match import all_lines


def ranges(results: DataFrame, files: DataFrame, context: int) -> DataFrame:
    """(file, island, start, end, n_matches) of results; files gives the numbers of lines."""
    totals = files.select(F.col("path").alias("file"), F.size(text_lines(F.make_valid_utf8("content"))).alias("total"))
    near = results.select("file", "line_number").join(totals, "file").select("file", "line_number", F.greatest(F.col("line_number") - context, F.lit(1)).alias("start"), F.least(F.col("line_number") + context, F.col("total")).alias("end"))
    order = Window.partitionBy("file").orderBy("line_number")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= reached + 1, 0).otherwise(1)
    islands = near.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return islands.groupBy("file", "island").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.count("*").alias("n_matches"))


def lines(results: DataFrame, files: DataFrame, context: int) -> DataFrame:
    """(file, island, line_number, line, is_match) of the ranges' lines."""
    found = ranges(results, files, context)
    # Only files with matches, by an equality on the file and a range of lines.
    hit = files.join(found.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
    inside = all_lines(hit).alias("l").join(found.alias("r"), (F.col("l.file") == F.col("r.file")) & F.col("l.line_number").between(F.col("r.start"), F.col("r.end")))
    shown = inside.select("l.file", "r.island", "l.line_number", "l.line")
    marks = results.select("file", "line_number").distinct().withColumn("m", F.lit(True))
    return shown.join(marks, ["file", "line_number"], "left").select("file", "island", "line_number", "line", F.coalesce("m", F.lit(False)).alias("is_match"))

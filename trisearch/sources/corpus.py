"""Corpora: any table with a path and a content column, or a folder of files.

A corpus is a relation (path, content, mtime, size) with one row for each text
file; files with a zero byte are binary and never part of it.
"""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import subprocess
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of a corpus.
SCHEMA = "path string, content string, mtime long, size long"

#: Paths of a list that are opened by name, are broadcast, and are written into a filter.
LISTED, BROADCAST, PUSHED = 200_000, 1_000_000, 1_000


def text_only(files: DataFrame) -> DataFrame:
    """Without binary files, and without rows whose path or content is null."""
    return files.where(F.col("path").isNotNull() & F.col("content").isNotNull() & ~F.contains("content", F.lit("\0")))


def from_table(df: DataFrame, path: str = "path", content: str = "content", mtime: str | None = None) -> DataFrame:
    """A corpus of a table's rows; rows with a null path or content are left out."""
    time = F.col(mtime).cast("long") if mtime else F.lit(0).cast("long")
    rows = df.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content"), time.alias("mtime"))
    return text_only(rows.withColumn("size", F.octet_length("content").cast("long"))).select("path", "content", "mtime", "size")


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression over relative paths, whether it lets in again)."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    again = rule.startswith("!")
    rule = rule[again:].removeprefix("\\")
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            out, i = out + fnmatch.translate(rule[i : end + 1])[4:-3].removesuffix(")"), end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("/.*" if folder else "(?:/.*)?"), again


def _rule_files(root: str) -> list[tuple[str, str, Path]]:
    """(what comes before a path, folder, file) of the ignore files outside of root that hold in it,
    the weakest first: the user's own, the repository's, and those of the folders above root."""
    found: list[tuple[str, str, Path]] = []
    made = subprocess.run(["git", "config", "--get", "--path", "core.excludesFile"], cwd=root, capture_output=True, text=True) if shutil.which("git") else None
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    found.append(("", "", Path(made.stdout.strip()) if made and made.stdout.strip() else home / "git" / "ignore"))
    top = next((f for f in (Path(root), *Path(root).parents) if (f / ".git").exists()), Path(root))
    below = os.path.relpath(root, top)
    before = "" if below == "." else below + "/"
    found.append((before, "", top / ".git/info/exclude"))
    folders = [top, *(top / Path(*Path(below).parts[:i]) for i in range(1, len(Path(below).parts)))] if before else []
    return found + [(before, os.path.relpath(f, top) + "/" if f != top else "", f / ".gitignore") for f in folders]


def walk(root: str) -> list[str]:
    """The relative paths of regular files below a local root, without hidden ones and those
    that ignore files name: .gitignore files of root, the folders in it and above it as far as
    the repository goes, .git/info/exclude and git's core.excludesFile."""
    found: list[str] = []
    rules: list[tuple[str, str, re.Pattern, bool]] = []

    def add(before: str, folder: str, file: Path):
        if file.is_file():
            for line in file.read_text(errors="replace").splitlines():
                if made := ignore_pattern(line):
                    rules.append((before, folder, re.compile(made[0]), made[1]))

    def ignored(path: str) -> bool:
        out = False
        for before, folder, pattern, again in rules:
            if (full := before + path).startswith(folder) and pattern.fullmatch(full[len(folder) :]):
                out = not again
        return out

    for rule_file in _rule_files(root):
        add(*rule_file)
    for at, dirs, files in os.walk(root):
        here = os.path.relpath(at, root)
        here = "" if here == "." else here + "/"
        add("", here, Path(at, ".gitignore"))
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not ignored(here + d + "/") and not ignored(here + d))
        found += [here + f for f in sorted(files) if not f.startswith(".") and not ignored(here + f) and os.path.isfile(os.path.join(at, f)) and not os.path.islink(os.path.join(at, f))]
    return sorted(found)


def _existing(spark: SparkSession, root: str, paths: list[str]) -> list[str]:
    """Those of the paths below root that are there."""
    if "://" not in root:
        return [p for p in paths if os.path.isfile(os.path.join(root, p))]
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, p))
    with ThreadPoolExecutor(32) as pool:
        return [p for p, ok in zip(paths, pool.map(there, paths), strict=True) if ok]


def restricted(files: DataFrame, paths: list[str] | DataFrame) -> DataFrame:
    """The rows of files whose path is among paths; those of a list reach the scan or are broadcast."""
    if isinstance(paths, DataFrame):
        return files.join(paths.select("path"), "path", "left_semi")
    if len(paths) <= PUSHED:
        return files.where(F.col("path").isin(paths)) if paths else files.limit(0)
    names = files.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    return files.join(F.broadcast(names) if len(paths) <= BROADCAST else names, "path", "left_semi")


def _listed(spark: SparkSession, root: str, paths: list[str] | DataFrame | None) -> DataFrame | None:
    """binaryFile rows of a folder with relative paths; None if there are no files."""
    base = (root if "://" in root else f"file://{Path(root).resolve()}").rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if paths is None and "://" not in root:
        paths = walk(root)
    if isinstance(paths, list):
        paths = _existing(spark, root, paths)
        if not paths:
            return None
    # In Spark's paths * ? [ ] { } and \\ are signs of patterns.
    plain = lambda p: re.sub(r"([\[\]{}*?\\])", r"\\\1", p)
    listed = isinstance(paths, list) and len(paths) <= LISTED
    files = read.load([plain(f"{base}/{p}") for p in paths] if listed else plain(base))
    # The URI's escapes are undone; what follows the root is the path.
    full = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^(\w+):/*", "$1:/")
    prefix = re.sub(r"^(\w+):/*", r"\1:/", base) + "/"
    rows = files.select(F.substring(full, F.lit(len(prefix) + 1), F.length(full)).alias("path"), F.col("content").cast("string").alias("content"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return rows if listed or paths is None else restricted(rows, paths)


def from_dir(spark: SparkSession, root: str, paths: list[str] | DataFrame | None = None) -> DataFrame:
    """A corpus of a folder. paths: of which files, relative to it, a list or a relation (path);
    None: of all that walk() finds, for a folder this machine can list, and else of all below
    root. Files of a list are opened by name, up to LISTED, and those that are gone are left out."""
    rows = _listed(spark, root, paths)
    return spark.createDataFrame([], SCHEMA) if rows is None else text_only(rows)


def names_of_dir(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of a folder's files, binary ones too; no file is opened."""
    rows = _listed(spark, root, None)
    return spark.createDataFrame([], "path string, mtime long, size long") if rows is None else rows.select("path", "mtime", "size")

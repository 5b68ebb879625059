"""The command line: python -m trisearch PATTERN [PATH], init, serve and status."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import tools
from .deploy import ship
from .engine import REFRESH_SECONDS, Config, Engine, SearchOptions
from .errors import InputOutput, SearchError
from .functions.filetypes import list_all_types
from .functions.hints import detect_regex_hint
from .operators import filters, formats
from .sources import git
from .sources import index as indexes

FOUND, NOTHING, ERROR = 0, 1, 2


def session() -> SparkSession:
    spark = SparkSession.builder.appName("trisearch").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def search_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trisearch", description="Search an indexed folder.", epilog="Commands: init [--local] [PATH], serve [--root PATH], status [PATH]")
    p.add_argument("pattern", nargs="?")
    p.add_argument("path", nargs="?", metavar="PATH")
    p.add_argument("--format", default="default", help="default or llm")
    p.add_argument("-i", dest="case_insensitive", action="store_true")
    p.add_argument("-C", dest="context", type=int)
    p.add_argument("--changed", action="store_true")
    p.add_argument("--since")
    p.add_argument("-e", dest="regex", action="store_true")
    p.add_argument("-t", "--type", dest="file_type")
    p.add_argument("-c", dest="count", action="store_true")
    p.add_argument("-l", dest="files_only", action="store_true")
    p.add_argument("--max-count", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--list-types", action="store_true")
    p.add_argument("--absolute-paths", action="store_true")
    p.add_argument("--find", action="store_true")
    p.add_argument("--no-hints", action="store_true")
    p.add_argument("--exclude", action="append", default=[], metavar="PATTERN")
    return p


def _env(name: str) -> bool:
    return os.environ.get(name, "") in ("1", "true")


def _target(path: str | None) -> tuple[str, str | None]:
    """The folder to search, and the file in it if the path is one."""
    p = Path(path or ".")
    if not p.exists():
        raise InputOutput(f"there is no {path}")
    p = p.resolve()
    return (str(p), None) if p.is_dir() else (str(p.parent), p.name)


def _folder(path: str | None) -> str:
    folder, file = _target(path)
    if file:
        raise InputOutput("a folder is needed, not a file")
    return folder


def find(spark: SparkSession, a, say) -> int:
    root = _folder(a.path)
    engine = Engine.open(spark, root)
    if a.changed:
        paths = filters.by_name(spark.createDataFrame([(p,) for p in git.changed_files(root)], "path string"), a.pattern)
    else:
        paths = engine.find_files(a.pattern)
    if a.file_type:
        paths = paths.where(filters.of_type(F.col("path"), a.file_type))
    paths = filters.without(paths, "path", a.exclude).orderBy("path")
    if a.max_count is not None:
        paths = paths.limit(a.max_count)
    names = [r[0] for r in paths.collect()]
    if not names:
        return NOTHING
    if a.count:
        say(len(names))
        return FOUND
    if a.absolute_paths:
        names = [os.path.join(root, n) for n in names]
    say(json.dumps(names, indent=2, ensure_ascii=False) if a.json else "\n".join(names))
    return FOUND


def refresh(engine: Engine) -> subprocess.Popen | None:
    """Starts a process that brings an old index up to date, as this one ends before."""
    index = engine.index()
    if index is None or time.time() - index.meta["built_at"] <= REFRESH_SECONDS or _env("TRISEARCH_NO_REFRESH"):
        return None
    local = ["--local"] if engine.index_path.startswith(engine.root + os.sep) else []
    quiet = subprocess.DEVNULL
    return subprocess.Popen([sys.executable, "-m", "trisearch", "init", engine.root, *local], cwd=Path(__file__).parents[1], stdin=quiet, stdout=quiet, stderr=quiet, start_new_session=True)


def search(spark: SparkSession, a, say) -> int:
    root, file = _target(a.path)
    engine = Engine.open(spark, root)
    if not (file or a.fresh or a.changed or a.since):
        refresh(engine)
    if file:
        results = engine.search_files([file], a.pattern, SearchOptions(a.case_insensitive, a.regex, max_count=a.max_count))
    else:
        results = engine.search(a.pattern, SearchOptions(a.case_insensitive, a.regex, a.file_type, a.max_count, a.changed, a.since, None, a.fresh))
    # The limit comes first, then what is excluded.
    results = filters.without(results, "file", a.exclude).cache()
    if results.isEmpty():
        return NOTHING
    top = root if a.absolute_paths else None
    name = lambda f: os.path.join(root, f) if top else f
    if a.count:
        say("\n".join(f"{name(r['file'])}:{r['n']}" for r in formats.count_per_file(results).orderBy("file").collect()))
    elif a.files_only:
        say("\n".join(name(r[0]) for r in formats.files_only(results).orderBy("file").collect()))
    elif a.json:
        rows = results.orderBy("file", "line_number").collect()
        say(json.dumps([{"file": name(r["file"]), "line_number": r["line_number"], "line": r["line"]} for r in rows], indent=2, ensure_ascii=False))
    elif a.format == "llm":
        context = a.context if a.context is not None else int(os.environ.get("TRISEARCH_LLM_CONTEXT", "3"))
        say(tools.markdown(engine, results, context, None, top))
    elif a.context is not None:
        files = engine.corpus([r[0] for r in results.select("file").distinct().collect()])
        say("\n--\n".join(r["text"] for r in formats.context_blocks(results, files, a.context, top).orderBy("file", "island").collect()))
    else:
        say("\n".join(r["text"] for r in formats.default_lines(results, top).orderBy("file", "line_number").collect()))
    return FOUND


def command(argv: list[str], say, complain) -> int:
    p = argparse.ArgumentParser(prog=f"trisearch {argv[0]}")
    p.add_argument("path", nargs="?")
    p.add_argument("--local", action="store_true")
    p.add_argument("--root")
    a = p.parse_args(argv[1:])
    root, spark = _folder(a.root or a.path), session()
    if argv[0] == "serve":
        tools.serve(Engine.open(spark, root).with_config(Config(quiet=True, refresh=True)))
    elif argv[0] == "init":
        engine = (Engine.open_local if a.local else Engine.open)(spark, root)
        began = time.time()
        engine.build_index()
        complain(f"Wrote {engine.index_path} ({indexes.size_on_disk(spark, engine.index_path)} bytes) in {time.time() - began:.2f}s")
    else:
        engine = Engine.open(spark, root)
        say(engine.index_status() if engine.index() else f"There is no index yet; 'trisearch init' makes one at {engine.index_path}")
    return FOUND


def main(argv: list[str] | None = None, say=print, complain=lambda text: print(text, file=sys.stderr)) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        if argv[:1] and argv[0] in ("init", "serve", "status"):
            return command(argv, say, complain)
        a = search_parser().parse_args(argv)
        if a.list_types:
            say("\n".join(f"{name:<14}{', '.join('*.' + e for e in exts)}" for name, exts in list_all_types()))
            return FOUND
        if a.json and a.format != "default":
            raise SearchError("--json and --format exclude each other")
        if a.count + a.files_only + a.json > 1:
            raise SearchError("only one of -c, -l and --json can be given")
        if a.pattern is None:
            complain("Usage: trisearch PATTERN [PATH] or trisearch init")
            return ERROR
        a.absolute_paths = a.absolute_paths or _env("TRISEARCH_ABSOLUTE_PATHS")
        if not (a.regex or a.find or a.no_hints or os.environ.get("TRISEARCH_NO_HINTS") == "1"):
            if hint := detect_regex_hint(a.pattern):
                complain(hint)
        return (find if a.find else search)(session(), a, say)
    except SearchError as e:
        complain(f"error: {e}")
        return ERROR

"""The engine: a corpus, its index, and searches over both."""

from __future__ import annotations

import hashlib
import logging
import os
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import IndexFailure, InputOutput, LockFailure
from .operators import filters, match, postings
from .plans import regex, trigrams
from .sources import corpus as corpora
from .sources import git
from .sources import index as indexes

log = logging.getLogger("trisearch")

#: Of the trigrams that all have to be there, so many are looked up, the rarest ones.
RAREST = 6
#: An index older than so many seconds is brought up to date after a search.
REFRESH_SECONDS = 30
#: Changed files beyond which an index is built anew.
MAX_CHANGED = 500
RESULTS = "file string, line_number int, line string"


@dataclass
class SearchOptions:
    case_insensitive: bool = False
    regex: bool = False
    file_type: str | None = None
    max_count: int | None = None
    changed_only: bool = False
    since: str | None = None
    path_pattern: str | None = None
    fresh: bool = False


@dataclass
class Config:
    """quiet: no warnings; refresh: whether searches bring an old index of a folder up to date, see refresh_later()."""

    quiet: bool = False
    refresh: bool = False


@dataclass
class Status:
    """kind: fresh, stale or needs_full_build; changed: the paths of a stale index."""

    kind: str
    changed: tuple[str, ...] = ()


def plan(pattern: str, options: SearchOptions, quiet: bool = False) -> trigrams.Query:
    """What files must have, by their trigrams; warns where it decides nothing."""
    query = trigrams.of_regex(pattern, options.case_insensitive) if options.regex else trigrams.literal(pattern, options.case_insensitive)
    if not quiet and query.op == "all":
        if not options.regex and len(pattern) < 3:
            log.warning("pattern '%s' is shorter than 3 characters, the index is not used", pattern)
        else:
            log.warning("pattern '%s' has no usable trigrams, all files are scanned", pattern)
    if not quiet and options.case_insensitive and not options.regex and not pattern.isascii():
        log.warning("only ASCII letters are matched in either case")
    return query


def search_files(files: DataFrame, pattern: str, options: SearchOptions | None = None, quiet: bool = False) -> DataFrame:
    """Searches a corpus (path, content) without an index; results are ordered and
    limited. Filters on paths come before contents are read."""
    o = options or SearchOptions()
    if o.file_type:
        files = files.where(filters.of_type(F.col("path"), o.file_type, quiet))
    if o.path_pattern:
        files = files.where(F.contains("path", F.lit(o.path_pattern)))
    return filters.ordered(match.find(files, pattern, o.case_insensitive, o.regex), o.max_count)


class Engine:
    """Searches a folder of files, or a table that stands for one."""

    def __init__(self, spark: SparkSession, root: str | None, index_path: str, corpus: DataFrame | None = None, config: Config | None = None):
        self.spark, self.root, self.index_path, self.config = spark, root, index_path, config or Config()
        self._corpus = corpus

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        """The index is in .trisearch below root if there is one, else in the user's cache."""
        root = os.path.realpath(root)
        if not os.path.isdir(root):
            raise InputOutput(f"no such folder: {root}")
        local = Path(root, ".trisearch", "index")
        if local.exists():
            return cls(spark, root, str(local))
        cache = Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache")
        return cls(spark, root, str(cache / "trisearch" / hashlib.sha256(root.encode()).hexdigest()[:16]))

    @classmethod
    def open_local(cls, spark: SparkSession, root: str) -> Engine:
        root = os.path.realpath(root)
        return cls(spark, root, str(Path(root, ".trisearch", "index")))

    @classmethod
    def from_table(cls, df: DataFrame, index_path: str, path: str = "path", content: str = "content", mtime: str | None = None) -> Engine:
        return cls(df.sparkSession, None, index_path, corpora.from_table(df, path, content, mtime))

    def with_config(self, config: Config) -> Engine:
        return Engine(self.spark, self.root, self.index_path, self._corpus, config)

    def corpus(self, paths: list[str] | DataFrame | None = None) -> DataFrame:
        if self._corpus is None:
            return corpora.from_dir(self.spark, self.root, paths)
        return self._corpus if paths is None else corpora.restricted(self._corpus, paths)

    def build_index(self, incremental: bool = True) -> indexes.Index:
        names = corpora.names_of_dir(self.spark, self.root) if self._corpus is None else None
        return indexes.build(self.corpus(), self.index_path, git.head(self.root) if self.root else None, incremental, names, self.corpus)

    def refresh_later(self, seconds: int = REFRESH_SECONDS) -> InheritableThread | None:
        """Brings an index that is older than seconds up to date in a thread of its own;
        searches use the old version until it is done. None if it isn't due or another build runs."""
        index = self.index()
        if index is None or time.time() - index.meta["built_at"] <= seconds:
            return None

        def build():
            try:
                self.build_index()
            except LockFailure:
                log.info("another build is under way")

        thread = InheritableThread(target=build, daemon=True)
        thread.start()
        return thread

    def index(self) -> indexes.Index | None:
        return indexes.open_index(self.spark, self.index_path) if indexes.current(self.spark, self.index_path) else None

    # Searching

    def candidates(self, index: indexes.Index, query: trigrams.Query) -> DataFrame:
        """(path) of the files that a query leaves, by the rarest trigrams where all of many have to be there."""
        query = self._rarest(index, query)
        if query.op == "all":
            return index.files.select("path")
        if query.op == "none":
            return index.files.select("path").limit(0)
        ids = postings.candidates(index.postings, query)
        return index.files.join(ids, "file_id", "left_semi").select("path")

    def _rarest(self, index: indexes.Index, query: trigrams.Query) -> trigrams.Query:
        if query.op != "and" or len(query.parts) <= RAREST or any(p.op != "gram" for p in query.parts):
            return query
        # A row for each trigram of the pattern at most.
        df = {r["g"]: r["df"] for r in index.grams.where(F.col("g").isin(sorted(query.grams()))).collect()}
        if len(df) < len(query.parts):
            return trigrams.NONE
        return trigrams.Query("and", tuple(sorted(query.parts, key=lambda p: (df[p.gram], p.gram))[:RAREST]))

    def _indexed(self, index: indexes.Index, pattern: str, o: SearchOptions) -> DataFrame:
        """Searches the files that the index leaves, as they are now; no others are opened."""
        paths = self.candidates(index, plan(pattern, o, self.config.quiet))
        some = [r["path"] for r in paths.limit(corpora.LISTED + 1).collect()]
        few = len(some) <= corpora.LISTED
        if self._corpus is not None and not few:
            # Of a table, lines are shuffled to meet so many paths, and not contents.
            found = match.find(self._corpus, pattern, o.case_insensitive, o.regex)
            return found.join(paths.select(F.col("path").alias("file")), "file", "left_semi")
        return match.find(self.corpus(some if few else paths), pattern, o.case_insensitive, o.regex)

    def search(self, pattern: str, options: SearchOptions | None = None) -> DataFrame:
        """(file, line_number, line), ordered by both; at most max_count rows in all."""
        o = options or SearchOptions()
        if o.regex:
            regex.parse(pattern, o.case_insensitive)
        if o.changed_only or o.since:
            paths: set[str] = set()
            if o.changed_only:
                paths |= set(git.changed_files(self.root))
            if o.since:
                paths |= set(git.since_files(self.root, o.since))
            found = match.find(self.corpus(sorted(paths)), pattern, o.case_insensitive, o.regex)
        else:
            found = self._search_index(pattern, o)
        if o.file_type:
            found = found.where(filters.of_type(F.col("file"), o.file_type, self.config.quiet))
        if o.path_pattern:
            found = found.where(F.contains("file", F.lit(o.path_pattern)))
        return filters.ordered(found, o.max_count)

    def _search_index(self, pattern: str, o: SearchOptions) -> DataFrame:
        index = self.index()
        if index is not None and not o.fresh:
            found = self._indexed(index, pattern, o)
            if self.config.refresh and self.root:
                self.refresh_later()
            return found
        status = self.status()
        if status.kind == "needs_full_build":
            return self._indexed(self.build_index(), pattern, o)
        found = self._indexed(index, pattern, o)
        if status.kind == "stale":
            direct = match.find(self.corpus(list(status.changed)), pattern, o.case_insensitive, o.regex)
            changed = self.spark.createDataFrame([(p,) for p in status.changed], "path string")
            found = filters.merge_fresh(found, direct, changed)
        return found

    def search_files(self, paths: list[str], pattern: str, options: SearchOptions | None = None) -> DataFrame:
        return search_files(self.corpus(paths), pattern, options, self.config.quiet)

    def find_files(self, pattern: str) -> DataFrame:
        """(path) of the index's files by glob or substring, ordered."""
        index = self.index() or self.build_index()
        return filters.by_name(index.files.select("path"), pattern).orderBy("path")

    # State

    def status(self) -> Status:
        try:
            index = self.index()
        except IndexFailure:
            index = None
        if index is None:
            return Status("needs_full_build")
        commit = git.head(self.root) if self.root else None
        if commit and index.meta["commit_hash"]:
            changed = set(git.uncommitted(self.root))
            if commit == index.meta["commit_hash"]:
                tracked = {p for line in git._git(self.root, "status", "--porcelain", "-uno") for p in git.status_paths(line)}
                changed = set(git._below(self.root, tracked))
            else:
                changed |= set(git.between(self.root, index.meta["commit_hash"], commit))
            if not changed:
                return Status("fresh")
            return Status("needs_full_build") if len(changed) > MAX_CHANGED else Status("stale", tuple(sorted(changed)))
        newest = self.corpus().agg(F.max("mtime")).first()[0] or 0
        return Status("needs_full_build" if newest > index.meta["newest"] else "fresh")

    def index_status(self) -> str:
        status = self.status()
        index = self.index()
        if index is None:
            return f"Index: not built\nIndex path: {self.index_path}"
        state = f"stale ({len(status.changed)} changed files)" if status.kind == "stale" else status.kind.replace("_", " ")
        return f"Index: {state}\nFiles: {index.meta['file_count']}\nSize: {indexes.size_on_disk(self.spark, self.index_path)} bytes\nIndex path: {self.index_path}\nLast built: {int(time.time()) - index.meta['built_at']}s ago"

"""What git says has changed, as lists of paths relative to a root."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputOutput, NotGitRepo
from ..functions.durations import parse_since


def _git(root: str, *args: str) -> list[str]:
    try:
        done = subprocess.run(["git", "-c", "core.quotepath=off", *args], cwd=root, capture_output=True, text=True, errors="replace")
    except OSError as e:
        raise InputOutput(str(e)) from e
    return done.stdout.splitlines() if done.returncode == 0 else []


def toplevel(root: str) -> str | None:
    found = _git(root, "rev-parse", "--show-toplevel")
    return found[0] if found else None


def head(root: str) -> str | None:
    found = _git(root, "rev-parse", "HEAD")
    return found[0] if found else None


def _below(root: str, paths) -> list[str]:
    """Paths of the repository as paths below root; others, and the index's own files, are left out."""
    top = toplevel(root)
    inside = os.path.relpath(os.path.realpath(root), os.path.realpath(top)) if top else "."
    prefix = "" if inside == "." else inside + "/"
    found = {p.removeprefix(prefix) for p in map(str.strip, paths) if p and p.startswith(prefix)}
    return sorted(p for p in found if not p.startswith(".trisearch/"))


def _need(root: str) -> None:
    if not toplevel(root):
        raise NotGitRepo


def changed_files(root: str) -> list[str]:
    """Tracked files that differ from the index or the last commit and still exist."""
    _need(root)
    paths = _git(root, "diff", "--name-only") + _git(root, "diff", "--cached", "--name-only")
    return [p for p in _below(root, paths) if os.path.exists(os.path.join(root, p))]


def since_files(root: str, duration: str) -> list[str]:
    """Files of the commits since a duration, or of the last commits, that still exist."""
    since = parse_since(duration)
    _need(root)
    span = [f"-{since.commits}"] if since.phrase is None else [f"--since={since.phrase}"]
    paths = _git(root, "log", *span, "--name-only", "--pretty=format:")
    return [p for p in _below(root, paths) if os.path.exists(os.path.join(root, p))]


def status_paths(line: str) -> list[str]:
    """The paths of a line of git status --porcelain: of a rename both, quotes taken off."""
    if len(line) < 4:
        return []
    parts = line[3:].split(" -> ", 1)
    return [q for p in parts if (q := p[1:-1] if len(p) > 1 and p[0] == p[-1] == '"' else p)]


def uncommitted(root: str) -> list[str]:
    """Tracked files with changes, both names of renamed ones, and untracked files."""
    tracked = [p for line in _git(root, "status", "--porcelain", "-uno") for p in status_paths(line)]
    untracked = _git(root, "ls-files", "--others", "--exclude-standard", "--full-name")
    return _below(root, tracked + untracked)


def between(root: str, old: str, new: str = "HEAD") -> list[str]:
    return _below(root, _git(root, "diff-tree", "-r", "--name-only", "--no-commit-id", old, new))


# A table of changes (path, ts, commit_id) in place of git.


def changed_paths(changes: DataFrame) -> DataFrame:
    return changes.select("path").distinct()


def changes_since(changes: DataFrame, duration: str, now) -> DataFrame:
    """The paths that changed within a duration before now (a timestamp column), or in the last commits."""
    since = parse_since(duration)
    if since.commits is None:
        return changed_paths(changes.where(F.col("ts") >= now - F.make_interval(secs=F.lit(since.seconds))))
    last = changes.groupBy("commit_id").agg(F.max("ts").alias("at")).orderBy(F.desc("at"), F.desc("commit_id")).limit(since.commits)
    return changed_paths(changes.join(F.broadcast(last), "commit_id", "left_semi"))

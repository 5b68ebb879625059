import io
import json
import subprocess

import pytest

from trisearch import cli, tools
from trisearch.engine import Config, Engine, SearchOptions
from trisearch.errors import IndexFailure, InvalidPattern, LockFailure, NotGitRepo
from trisearch.sources import corpus as corpora
from trisearch.sources import git
from trisearch.sources import index as indexes
from trisearch.streaming import index_stream


def run(root, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=root, check=True, capture_output=True)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    (root / "src").mkdir(parents=True)
    (root / "src/main.rs").write_text("fn main() {\n    handle_auth();\n}\n")
    (root / "src/lib.py").write_text("def handle_auth():\n    pass\n")
    (root / "README.md").write_text("nothing here")
    (root / "bin.dat").write_bytes(b"handle_auth\0")
    (root / ".hidden").write_text("handle_auth")
    (root / "skip.log").write_text("handle_auth")
    (root / ".gitignore").write_text("*.log\nbuild/\n")
    (root / "build").mkdir()
    (root / "build/out.rs").write_text("handle_auth")
    return root


def test_walk_and_read(spark, folder, rows):
    assert corpora.walk(str(folder)) == ["README.md", "bin.dat", "src/lib.py", "src/main.rs"]
    files = corpora.from_dir(spark, str(folder))
    assert sorted(r["path"] for r in files.collect()) == ["README.md", "src/lib.py", "src/main.rs"]
    (folder / "a b+ü.txt").write_text("odd name")
    assert "a b+ü.txt" in {r["path"] for r in corpora.from_dir(spark, str(folder)).collect()}


def test_index_and_search(spark, folder, rows):
    engine = Engine.open_local(spark, str(folder)).with_config(Config(quiet=True))
    with pytest.raises(IndexFailure):
        indexes.open_index(spark, engine.index_path)
    index = engine.build_index()
    assert index.meta["file_count"] == 3 and engine.status().kind in ("fresh", "needs_full_build")
    assert [r[0] for r in rows(engine.search("handle_auth"))] == ["src/lib.py", "src/main.rs"]
    assert rows(engine.search("handle_\\w+\\(", SearchOptions(regex=True, file_type="rust"))) == [("src/main.rs", 2, "    handle_auth();")]
    assert rows(engine.search("absent_word")) == []
    assert [r[0] for r in rows(engine.find_files("*.rs"))] == ["src/main.rs"]
    with pytest.raises(InvalidPattern):
        engine.search("[bad", SearchOptions(regex=True))


def test_incremental_build_equals_a_full_one(spark, tmp_path, rows):
    make = lambda items: spark.createDataFrame([(p, c, t, len(c)) for p, c, t in items], "path string, content string, mtime long, size long")
    first = make([("a", "alpha", 1), ("b", "beta", 1), ("c", "gamma", 1)])
    second = make([("a", "alpha", 1), ("b", "BETA", 2), ("d", "delta", 1)])
    read = lambda i: rows(i.postings.join(i.files, "file_id").select("path", "g"))
    indexes.build(first, str(tmp_path / "x"))
    step = indexes.build(second, str(tmp_path / "x"))
    full = indexes.build(second, str(tmp_path / "y"))
    assert read(step) == read(full) and step.meta["file_count"] == 3
    again = indexes.build(second, str(tmp_path / "x"))
    assert read(again) == read(full)


def test_refresh_later(spark, folder, rows):
    import trisearch

    engine = trisearch.Engine.open_local(spark, str(folder)).with_config(Config(quiet=True))
    assert engine.refresh_later() is None
    engine.build_index()
    assert engine.refresh_later(60) is None
    (folder / "late.py").write_text("late_word")
    engine.refresh_later(-1).join()
    assert rows(engine.find_files("late")) == [("late.py",)]


def test_empty_corpus(spark, tmp_path, rows):
    empty = spark.createDataFrame([], corpora.SCHEMA)
    index = indexes.build(empty, str(tmp_path / "x"))
    assert index.meta["file_count"] == 0 and rows(index.postings) == []


def test_lock(spark, tmp_path):
    path = str(tmp_path / "x")
    with indexes.Lock(spark, path):
        with pytest.raises(LockFailure):
            indexes.Lock(spark, path).__enter__()
    with indexes.Lock(spark, path):
        pass


def test_status_lines():
    assert git.status_paths(" M a.rs") == ["a.rs"]
    assert git.status_paths("R  old.rs -> new.rs") == ["old.rs", "new.rs"]
    assert git.status_paths(' M "a b.rs"') == ["a b.rs"]
    assert git.status_paths("M") == git.status_paths("") == []


def test_changes(spark, folder, rows):
    with pytest.raises(NotGitRepo):
        git.changed_files(str(folder))
    run(folder, "init", "-q")
    run(folder, "add", ".")
    run(folder, "commit", "-qm", "one")
    engine = Engine.open_local(spark, str(folder)).with_config(Config(quiet=True))
    engine.build_index()
    assert git.changed_files(str(folder)) == []
    assert rows(engine.search("handle_auth", SearchOptions(changed_only=True))) == []
    (folder / "src/lib.py").write_text("# new\ndef handle_auth():\n")
    (folder / "new.py").write_text("handle_auth")
    assert git.changed_files(str(folder)) == ["src/lib.py"]
    assert git.uncommitted(str(folder)) == ["new.py", "src/lib.py"]
    assert rows(engine.search("handle_auth", SearchOptions(changed_only=True))) == [("src/lib.py", 2, "def handle_auth():")]
    assert engine.status().kind == "stale"
    fresh = rows(engine.search("handle_auth", SearchOptions(fresh=True)))
    assert fresh == [("src/lib.py", 2, "def handle_auth():"), ("src/main.rs", 2, "    handle_auth();")]
    run(folder, "commit", "-qam", "two")
    assert git.since_files(str(folder), "1.commits") == ["src/lib.py"]
    assert "src/main.rs" in git.since_files(str(folder), "1h")


def call(engine, name, **arguments):
    reply = tools.handle(engine, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    return reply["result"]["content"][0]["text"], reply["result"].get("isError", False)


def test_tools(spark, folder):
    engine = Engine.open_local(spark, str(folder)).with_config(Config(quiet=True))
    assert call(engine, "build_index")[0].startswith("The index is up to date")
    text, failed = call(engine, "search", pattern="handle_auth", context_lines=0)
    assert not failed and text.startswith("Found 2 matches in 2 files\n\n## src/lib.py:1\n\n```python\ndef handle_auth():\n```\n\n## src/main.rs:2")
    assert call(engine, "search", pattern="handle_auth", max_results=1)[0].startswith("Found 1+ matches in 1 files (limited to 1)")
    assert "more matches in 1 more files" in call(engine, "search", pattern="handle_auth", max_tokens=1)[0]
    assert call(engine, "find_definitions", symbol="handle_auth")[0].startswith("Found 1 definitions of 'handle_auth' in 1 files")
    assert call(engine, "read_file", path="src/main.rs", start_line=2, end_line=2)[0] == "## src/main.rs:2-2\n\n```rust\n   2 |     handle_auth();\n```\n"
    assert call(engine, "read_file", path="../x")[1] and call(engine, "search")[1]
    assert call(engine, "search", pattern="x", max_results=-1) == ("'max_results' takes a number from 0 on, not -1", True)
    assert call(engine, "search", pattern="x", regex="yes")[1]
    assert "Files: 3" in call(engine, "index_status")[0]


def test_server(spark, folder):
    engine = Engine.open_local(spark, str(folder))
    out = io.StringIO()
    lines = ['{"id":1,"method":"initialize"}', '{"id":2,"method":"tools/list"}', '{"method":"note"}', "", "{bad", '{"id":3,"method":"nope"}', '{"id":4,"method":"tools/call","params":{"name":"nope"}}']
    tools.serve(engine, lines, out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[0]["result"]["serverInfo"]["name"] == "trisearch" and len(replies[1]["result"]["tools"]) == 5
    assert [r["error"]["code"] for r in replies[2:]] == [-32700, -32601, -32602]


def test_command_line(spark, folder, monkeypatch, tmp_path):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    monkeypatch.setattr(cli, "session", lambda: spark)

    def cmd(*args):
        said, complaints = [], []
        code = cli.main(list(args), lambda t: said.append(str(t)), complaints.append)
        return code, "\n".join(said), "\n".join(complaints)

    root = str(folder)
    assert cmd("init", root)[0] == 0 and "Files: 3" in cmd("status", root)[1]
    assert cmd("handle_auth", root)[:2] == (0, "src/lib.py:1:def handle_auth():\nsrc/main.rs:2:    handle_auth();")
    assert cmd("absent", root)[0] == 1 and cmd("x", "/no/such/path")[0] == 2
    assert cmd("handle_auth", root, "-c")[1] == "src/lib.py:1\nsrc/main.rs:1"
    assert cmd("handle_auth", root, "-l", "--absolute-paths")[1].splitlines()[0] == f"{root}/src/lib.py"
    assert json.loads(cmd("handle_auth", root, "--json", "-t", "py")[1]) == [{"file": "src/lib.py", "line_number": 1, "line": "def handle_auth():"}]
    assert cmd("handle_auth", root, "-C", "1", "--exclude", ".py")[1] == "src/main.rs-1-fn main() {\nsrc/main.rs:2:    handle_auth();\nsrc/main.rs-3-}"
    assert cmd("handle_auth", root, "--format", "llm", "-C", "0", "--max-count", "1")[1] == "## src/lib.py:1\n\n```python\ndef handle_auth():\n```\n"
    assert cmd("--find", "*.rs", root)[1] == "src/main.rs" and cmd("--find", "s", root, "-c")[1] == "2"
    assert json.loads(cmd("--find", ".py", root, "--json")[1]) == ["src/lib.py"]
    assert cmd("x", root, "-c", "-l")[0] == 2 and cmd("x", root, "--json", "--format", "llm")[0] == 2
    assert "hint:" in cmd(r"a\|b", root)[2] and cmd(r"a\|b", root, "--no-hints")[2] == ""
    assert cmd("handle_auth", f"{root}/src/lib.py")[1] == "lib.py:1:def handle_auth():"
    assert len(cmd("--list-types")[1].splitlines()) == 34
    assert cmd("x", root, "--since", "abc")[0] == 2


def test_stream(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "abcd"), ("b", "x\0yz"), ("c", None)], "path string, content string").write.parquet(source)
    stream = spark.readStream.schema("path string, content string").parquet(source)
    target = str(tmp_path / "out")
    index_stream.start(stream, target, str(tmp_path / "check")).awaitTermination()
    assert [r[0] for r in rows(index_stream.postings(spark, target))] == ["a", "a"]
    spark.createDataFrame([("a", "abc"), ("d", "abc")], "path string, content string").write.mode("append").parquet(source)
    index_stream.start(stream, target, str(tmp_path / "check")).awaitTermination()
    assert [r[0] for r in rows(index_stream.postings(spark, target))] == ["a", "d"]
    index_stream.compact(spark, target, str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2


def opened(df):
    """The files that a plan's scans of whole files open, and whether contents are shuffled."""
    plan = df._jdf.queryExecution()
    return set(df.inputFiles()), plan.executedPlan().toString()


def test_only_candidates_are_opened(spark, folder, rows):
    engine = Engine.open_local(spark, str(folder)).with_config(Config(quiet=True))
    engine.build_index()
    found = engine.search("nothing")
    files, plan = opened(found)
    assert {f.rsplit("/", 1)[1] for f in files if ".parquet" not in f} == {"README.md"}
    assert rows(found) == [("README.md", 1, "nothing here")]
    (folder / "README.md").unlink()
    assert rows(engine.search("nothing")) == []
    (folder / "a [b] {c}*?.md").write_text("odd thing")
    engine.build_index()
    assert rows(engine.search("odd")) == [("a [b] {c}*?.md", 1, "odd thing")]


def test_results_do_not_depend_on_how_files_are_read(spark, folder, tmp_path, rows, monkeypatch):
    engine = Engine.open_local(spark, str(folder)).with_config(Config(quiet=True))
    engine.build_index()
    table = Engine.from_table(corpora.from_dir(spark, str(folder)).cache(), str(tmp_path / "i")).with_config(Config(quiet=True))
    table.build_index()
    (folder / "later.py").write_text("handle_auth")
    newer = Engine.from_table(corpora.from_dir(spark, str(folder)), str(tmp_path / "i")).with_config(Config(quiet=True))
    expected = rows(engine.search("handle_auth"))
    assert [r[0] for r in expected] == ["src/lib.py", "src/main.rs"] and rows(table.search("handle_auth")) == rows(newer.search("handle_auth")) == expected
    monkeypatch.setattr(corpora, "PUSHED", 0)
    assert rows(newer.search("handle_auth")) == expected
    monkeypatch.setattr(corpora, "LISTED", 0)
    monkeypatch.setattr(corpora, "BROADCAST", 0)
    assert rows(engine.search("handle_auth")) == rows(newer.search("handle_auth")) == expected


def test_two_bytes_are_looked_up(spark, tmp_path, rows):
    items = [("a", "xyab"), ("b", "ab"), ("c", "abc"), ("d", "a b"), ("e", "ba"), ("f", "éa\nb"), ("g", "AB")]
    engine = Engine.from_table(spark.createDataFrame(items, "path string, content string"), str(tmp_path / "i")).with_config(Config(quiet=True))
    index = engine.build_index()
    from trisearch.plans import trigrams

    left = lambda q: [r[0] for r in rows(engine.candidates(index, q))]
    assert left(trigrams.literal("ab")) == ["a", "b", "c"] and left(trigrams.literal("aB", True)) == ["a", "b", "c", "g"] and left(trigrams.literal("é")) == ["f"]
    assert [r[0] for r in rows(engine.search("ab"))] == ["a", "b", "c"] and rows(engine.search("zq")) == []
    plan = index.postings.where("g between 6382080 and 6382335")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(g" in plan


def test_builds_do_not_shuffle_contents_and_keep_old_versions(spark, tmp_path, rows, monkeypatch):
    items = [(f"p{i}", f"text number {i}") for i in range(50)]
    path = str(tmp_path / "i")
    made = indexes._read(corpora.from_table(spark.createDataFrame(items, "path string, content string")))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    engine = Engine.from_table(spark.createDataFrame(items, "path string, content string"), path)
    first = engine.build_index()
    held = first.files
    assert sorted(r[0] for r in rows(first.files.select("file_id"))) == list(range(50))
    second = Engine.from_table(spark.createDataFrame([*items[:40], ("p60", "more")], "path string, content string"), path).build_index()
    assert held.count() == 50 and (second.meta["file_count"], second.meta["kept_files"], second.meta["read_files"]) == (41, 40, 1)
    monkeypatch.setattr(indexes, "KEEP_SECONDS", -1)
    third = engine.build_index()
    assert [p.name for p in (tmp_path / "i").glob("v-*")] == [third.path.rsplit("/", 1)[1]] and third.meta["build"] == 3


def test_the_rarest_trigrams_are_looked_up(spark, tmp_path, rows):
    items = [(f"p{i:02}", "common words in every file" + (" and rare zyxwvq" if i % 10 == 3 else "")) for i in range(30)]
    engine = Engine.from_table(spark.createDataFrame(items, "path string, content string"), str(tmp_path / "i")).with_config(Config(quiet=True))
    index = engine.build_index()
    from trisearch.plans import trigrams

    asked = trigrams.literal("every file and rare zyxwvq")
    some = engine._rarest(index, asked)
    df = {r.g: r.df for r in index.grams.collect()}
    assert some.grams() < asked.grams() and all(df[g] == 3 for g in some.grams()) and df == {r.g: r["count"] for r in index.postings.groupBy("g").count().collect()}
    assert [r[0] for r in rows(engine.search("every file and rare zyxwvq"))] == ["p03", "p13", "p23"]
    assert engine._rarest(index, trigrams.literal("common words nowhere")) is trigrams.NONE and rows(engine.search("common words nowhere")) == []
    assert len(rows(engine.search("common words in"))) == 30


def test_limits_are_errors(spark, tmp_path, monkeypatch):
    engine = Engine.from_table(spark.createDataFrame([("a", "abcdef"), ("b", "x")], "path string, content string"), str(tmp_path / "i"))
    monkeypatch.setattr(indexes, "MAX_FILES", 1)
    with pytest.raises(IndexFailure, match="2 files"):
        engine.build_index()
    monkeypatch.setattr(indexes, "MAX_FILES", 2)
    monkeypatch.setattr(indexes, "MAX_GRAMS", 3)
    with pytest.raises(IndexFailure, match="7 distinct trigrams"):
        engine.build_index()


def test_a_held_lock_is_renewed(spark, tmp_path, monkeypatch):
    import os
    import time

    monkeypatch.setattr(indexes, "RENEW_SECONDS", 0.2)
    path = str(tmp_path / "x")
    with indexes.Lock(spark, path) as lock:
        os.utime(lock.path, (1, 1))
        time.sleep(1)
        assert os.stat(lock.path).st_mtime > 1000
        with pytest.raises(LockFailure):
            indexes.Lock(spark, path).__enter__()


def test_searches_refresh_an_old_index(spark, folder, monkeypatch):
    engine = Engine.open_local(spark, str(folder)).with_config(Config(quiet=True, refresh=True))
    engine.build_index()
    asked = []
    monkeypatch.setattr(Engine, "refresh_later", lambda self: asked.append(1))
    engine.search("nothing")
    engine.search("nothing", SearchOptions(fresh=True))
    engine.with_config(Config(quiet=True)).search("nothing")
    assert asked == [1]
    monkeypatch.setattr(cli, "REFRESH_SECONDS", -1)
    monkeypatch.delenv("TRISEARCH_NO_REFRESH")
    started = []
    monkeypatch.setattr(cli.subprocess, "Popen", lambda args, **_: started.append(args))
    cli.refresh(engine)
    assert started[0][1:] == ["-m", "trisearch", "init", engine.root, "--local"]


def test_ignore_files_outside_of_the_folder(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / "config/git").mkdir(parents=True)
    (tmp_path / "config/git/ignore").write_text("*.tmp\n")
    root = tmp_path / "repo"
    (root / "a/b").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".gitignore").write_text("*.log\n/a/b/top.txt\n/plain.txt\n")
    (root / "a/.gitignore").write_text("b/x*\n!keep.log\n")
    for name in ("plain.txt", "top.txt", "x1", "y.log", "keep.log", "z.tmp"):
        (root / "a/b" / name).write_text("t")
    assert corpora.walk(str(root / "a/b")) == ["keep.log", "plain.txt"]


def test_stream_takes_files_out(spark, tmp_path, rows):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for items in ([("a", "abcd"), ("b", "abc"), ("c", "abc")], [("a", "x"), ("b", None)]):
        spark.createDataFrame(items, "path string, content string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("path string, content string").parquet(source)
        index_stream.start(stream, target, str(tmp_path / "check")).awaitTermination()
    assert rows(index_stream.postings(spark, target)) == [("c", 0x616263)]


def test_a_posting_is_no_row(spark, tmp_path, rows):
    """An index has a row for each trigram of a run of files, and one of another format is built anew."""
    items = [(f"p{i}", f"same words {i % 7}") for i in range(400)]
    path = str(tmp_path / "i")
    index = Engine.from_table(spark.createDataFrame(items, "path string, content string").coalesce(1), path).build_index()
    assert index.postings.count() > 4000 and index.lists.count() == index.meta["trigram_count"] == index.grams.count()
    assert rows(index.files.groupBy("run").count().select("count")) == [(400,)]
    meta = f"{index.path}/meta"
    old = spark.createDataFrame([(4,)], "format_version int")
    old.write.mode("overwrite").parquet(meta)
    assert Engine.from_table(spark.createDataFrame(items, "path string, content string"), path).build_index().meta["read_files"] == 400


def test_lists_lose_files_step_by_step(spark, tmp_path, rows):
    make = lambda ids, t=1: spark.createDataFrame([(f"p{i:03}", f"text {i} of many {i % 3}", t, 20) for i in ids], "path string, content string, mtime long, size long")
    read = lambda i: rows(i.postings.join(i.files, "file_id").select("path", "g"))
    steps = [make(range(60)), make(i for i in range(60) if i % 2), make(i for i in range(60) if i % 6 == 1).union(make([2, 58], 2)), make([7, 58], 2)]
    for step in steps:
        made = indexes.build(step, str(tmp_path / "x"))
        assert read(made) == read(indexes.build(step, str(tmp_path / "y"), incremental=False))
    assert made.lists.join(made.files, "run", "left_anti").count() == 0


def test_many_paths_meet_lines_and_not_contents(spark, tmp_path, rows, monkeypatch):
    items = [(f"p{i:02}", f"some hit\nother {i}" if i % 2 else "none") for i in range(30)]
    engine = Engine.from_table(spark.createDataFrame(items, "path string, content string"), str(tmp_path / "i")).with_config(Config(quiet=True))
    engine.build_index()
    expected = rows(engine.search("some hit"))
    monkeypatch.setattr(corpora, "LISTED", 0)
    found = engine.search("some hit")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi, (file#" in plan and rows(found) == expected and len(expected) == 15

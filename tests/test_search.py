import random

import pytest
from pyspark.sql import functions as F

from trisearch.engine import SearchOptions, search_files
from trisearch.operators import context, filters, formats, match, postings
from trisearch.plans import trigrams
from trisearch.sources.corpus import from_table

BASIC = {"a.rs": "fn handle_auth() {}\nfn other() {}\n", "b.rs": "fn main() { handle_auth(); }"}


def test_literal(corpus, rows):
    files = corpus(BASIC)
    assert rows(match.literal(files, "handle_auth")) == [("a.rs", 1, "fn handle_auth() {}"), ("b.rs", 1, "fn main() { handle_auth(); }")]
    assert rows(match.literal(files, "absent")) == []
    assert rows(match.literal(corpus({"x": "cost $100.00 now"}), "$100.00")) == [("x", 1, "cost $100.00 now")]
    assert rows(match.literal(corpus({"x": "a a a"}), "a")) == [("x", 1, "a a a")]


def test_empty_pattern_and_empty_file(corpus, rows):
    files = corpus({"e": "", "one": "x\n"})
    assert rows(match.literal(files, "")) == [("e", 1, ""), ("one", 1, "x")]
    assert rows(match.literal_ignoring_case(files, "")) == [("one", 1, "x")]
    assert rows(match.regular(files, "")) == [("one", 1, "x")]


def test_carriage_returns(corpus, rows):
    files = corpus({"x": "ab\r\nab\r"})
    assert rows(match.literal(files, "ab")) == [("x", 1, "ab\r"), ("x", 2, "ab\r")]
    assert rows(match.regular(files, "ab")) == [("x", 1, "ab"), ("x", 2, "ab\r")]


def test_literal_over_lines(corpus, rows):
    assert rows(match.literal(corpus({"x": "a\na\na\n"}), "a\na")) == [("x", 1, "a"), ("x", 2, "a")]
    assert rows(match.literal(corpus({"x": "a\n"}), "a\n")) == [("x", 1, "a")]
    assert rows(match.literal_ignoring_case(corpus({"x": "a\na"}), "a\na")) == []


def test_ignoring_case(corpus, rows):
    files = corpus({"u": "HELLO WORLD", "l": "hello world", "m": "Hello World", "n": "bye", "é": "É\né"})
    assert {r[0] for r in rows(match.literal_ignoring_case(files, "hello WORLD"))} == {"u", "l", "m"}
    assert rows(match.literal_ignoring_case(files, "É")) == [("é", 2, "é")]


def test_regex(corpus, rows):
    files = corpus({"a": "fn handle_one\nfn handle_two\nfn other", "b": "foo\nbar"})
    assert len(rows(match.regular(files, r"handle_\w+"))) == 2
    assert rows(match.regular(files, "^bar")) == []
    assert rows(match.regular(files, "^bar", line_anchors=True)) == [("b", 2, "bar")]
    assert rows(match.regular(files, "(?m)^bar$")) == [("b", 2, "bar")]
    assert rows(match.regular(corpus({"x": "foo\n"}), "foo$")) == []
    assert len(rows(match.regular(corpus({"x": "hello\nworld"}), ".*"))) == 2
    assert rows(match.regular(corpus({"x": "straße Ä"}), "ä", ignore_case=True)) == [("x", 1, "straße Ä")]


def test_binary_and_null_rows_are_left_out(spark, rows):
    df = spark.createDataFrame([("a", "x\0y", 1), ("b", "x", 2), ("c", None, 3), (None, "x", 4), ("b", "x", 2)], "path string, content string, line int")
    assert rows(match.literal(from_table(df), "x")) == [("b", 1, "x"), ("b", 1, "x")]


def test_empty_table(spark, rows):
    files = from_table(spark.createDataFrame([], "path string, content string"))
    for found in (match.literal(files, "x"), match.regular(files, "x"), match.literal_ignoring_case(files, "x")):
        assert rows(found) == []
    assert rows(context.lines(match.literal(files, "x"), files, 2)) == []


def test_filters_and_limits(corpus, rows):
    files = corpus({"src/auth/a.rs": "hit\nhit\nhit", "src/db/b.py": "hit\nhit"})
    find = lambda **o: rows(search_files(files, "hit", SearchOptions(**o)))
    assert len(find(file_type="RS")) == 3 and len(find(file_type="unknown")) == 5
    assert len(find(path_pattern="db/")) == 2
    assert find(max_count=2) == [("src/auth/a.rs", 1, "hit"), ("src/auth/a.rs", 2, "hit")]
    assert rows(filters.without(search_files(files, "hit", SearchOptions(max_count=2)), "file", ["auth", ""])) == []


def test_find(spark, rows):
    paths = spark.createDataFrame([(p,) for p in ("src/main.rs", "src/lib.rs", "src/util.py", "README.md", "Makefile", "makefile.bak")], "path string")
    assert len(rows(filters.by_name(paths, "*.rs"))) == 2
    assert len(rows(filters.by_name(paths, "MAKE"))) == 2
    assert rows(filters.by_name(paths, "[ms]*")) == [("makefile.bak",), ("src/lib.rs",), ("src/main.rs",), ("src/util.py",)]


def test_trigrams(spark, rows):
    files = spark.createDataFrame([(1, "hello"), (2, "ab"), (3, "aaaa"), (4, None), (5, "")], "file_id long, content string")
    found = rows(postings.extract(files))
    assert found == sorted([(1, 0x656C6C), (1, 0x68656C), (1, 0x6C6C6F), (3, 0x616161)], key=str)
    assert rows(postings.prefix_lookup(postings.extract(files), b"he")) == [(1,)]


def test_candidates(spark, rows):
    files = spark.createDataFrame([(i, t) for i, t in enumerate(["foobar", "foo only", "bar only", "none"])], "file_id long, content string")
    made = postings.extract(files)
    ids = lambda p: [r[0] for r in rows(postings.candidates(made, trigrams.of_regex(p)))]
    assert ids("foo.*bar") == [0] and ids("foo|bar") == [0, 1, 2] and ids("foo(bar| on)") == [0, 1]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_pruning_never_loses_a_match(spark, ignore_case):
    rnd = random.Random(5)
    letters = "abkS\n.é"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(150)]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string").cache()
    made = postings.extract(files).cache()
    parts = ["a", "b", "k", "S", "é", "ab", "kS", ".", "[ab]", "a|bk", "(ab|k)", "a+", "b*", "S?", "(ab){2}", "bab", "aSb"]
    for _ in range(25):
        pattern = "".join(f"(?:{p})" if "|" in p else p for p in rnd.choices(parts, k=rnd.randrange(1, 5)))
        query = trigrams.of_regex(pattern, ignore_case)
        if query.op == "all":
            continue
        named = files.withColumn("path", files.file_id.cast("string"))
        hits = {int(r.file) for r in match.regular(named, pattern, ignore_case).select("file").distinct().collect()}
        assert hits <= {r.file_id for r in postings.candidates(made, query).collect()}, pattern


def test_context(corpus, rows):
    files = corpus({"f": "\n".join(f"l{i}" for i in range(1, 21))})
    results = files.sparkSession.createDataFrame([("f", n, "") for n in (3, 5, 12, 13, 20)], "file string, line_number int, line string")
    assert [(r[2], r[3]) for r in rows(context.ranges(results, files, 1))] == [(2, 6), (11, 14), (19, 20)]
    shown = [r for r in rows(context.lines(results, files, 1)) if r[1] == 3]
    assert shown == [("f", 3, 19, "l19", False), ("f", 3, 20, "l20", True)]


def test_formats(corpus, rows):
    files = corpus({"a.rs": "1\n2\nhit\n4\n5", "b.xyz": "hit"})
    results = match.literal(files, "hit")
    assert [r[2] for r in rows(formats.default_lines(results, "/r"))] == ["/r/a.rs:3:hit", "/r/b.xyz:1:hit"]
    assert [r[2] for r in rows(formats.context_blocks(results, files, 1))] == ["a.rs-2-2\na.rs:3:hit\na.rs-4-4", "b.xyz:1:hit"]
    blocks = formats.markdown_blocks(results, files, 1)
    assert [r[2] for r in rows(blocks)] == ["## a.rs:2-4\n\n```rust\n2\nhit\n4\n```\n", "## b.xyz:1\n\n```\nhit\n```\n"]
    assert rows(formats.count_per_file(results)) == [("a.rs", 1), ("b.xyz", 1)]
    assert rows(formats.files_only(results)) == [("a.rs",), ("b.xyz",)]
    assert rows(formats.summary(results, 2))[0] == (2, 2, True, "Found 2+ matches in 2 files (limited to 2)")
    budget = rows(formats.within_budget(blocks, results, 5))
    assert [(r[0], r[3], r[4]) for r in budget] == [("a.rs", 1, 1)]
    assert [r[0] for r in rows(formats.within_budget(blocks, results, 10_000))] == ["a.rs", "b.xyz"]


def test_trigrams_in_sql_of_long_texts(spark, rows):
    """What a text costs grows with its length, not with its square; bytes that are no UTF-8 count as they are."""
    long = "".join(random.Random(3).choices("abcdeé", k=600_000))
    files = spark.createDataFrame([(1, long), (2, "ab"), (3, None), (4, "aaaa")], "file_id long, content string")
    files = files.unionByName(spark.sql("SELECT 5L AS file_id, CAST(X'61FF6263' AS STRING) AS content"))
    plain = postings.extract(files).selectExpr("file_id", "lpad(hex(g), 6, '0') AS g")
    made = files.select("file_id", F.explode(postings.trigrams_sql(F.col("content"))).alias("g"))
    assert rows(made) == rows(plain) and (5, "61FF62") in rows(made)


def test_pages_of_one_address_keep_their_definitions(spark, tmp_path, rows):
    from trisearch import queries

    html = ["<b>\nvar t=1; function track(x)\n", "<i>\nvar t=2;\n", "<i>\nvar t=2;\n", "none"]
    spark.createDataFrame([(i, "https://a.example/x", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = rows(queries.queries()["find_definitions"](spark, str(tmp_path)))
    assert found == [("https://a.example/x", 2, line) for line in ("var t=1; function track(x)", "var t=2;", "var t=2;")]


def test_trigrams_of_runs(spark):
    """Contents whose trigrams are sorted together have few bytes in all, a longer one is taken in parts."""
    import pyarrow as pa

    rnd = random.Random(4)
    sizes = [1 << 20, 1 << 20, 1 << 19, 5 << 20, 3, *[0] * 5000, 7]
    contents = [bytes(rnd.choices(b"abc\xc3", k=n)) for n in sizes]
    runs = list(postings.together(pa.RecordBatch.from_arrays([pa.array(contents)], names=["content"]), 0))
    assert [c for _, run in runs for c in run] == contents and [at for at, _ in runs] == [sum(len(r) for _, r in runs[:i]) for i in range(len(runs))]
    assert all(len(run) <= postings.RUN and (len(run) == 1 or sum(map(len, run)) <= postings.TOGETHER) for _, run in runs)
    for run in ([b"abcab", b"", b"a", b"ab", b"aaaa"], [contents[3]], [b"abc"], [b""], []):
        for ends in (False, True):
            which, g = postings.grams_of(run, ends)
            wide = [c + b"\0\0" if ends else c for c in run]
            expected = {(int.from_bytes(c[i : i + 3]), k) for k, c in enumerate(wide) for i in range(len(c) - 2)}
            assert list(zip(g.tolist(), which.tolist())) == sorted(expected)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    postings.extract(spark.createDataFrame([(1, "a")], "file_id long, content string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= postings.TOGETHER

import pytest

from trisearch.errors import InvalidArgument, InvalidPattern
from trisearch.functions.durations import parse_since
from trisearch.functions.filetypes import extensions_for_type, list_all_types
from trisearch.functions.hints import detect_regex, detect_regex_hint
from trisearch.plans import regex, trigrams


def grams(*words):
    return {w.encode()[0] << 16 | w.encode()[1] << 8 | w.encode()[2] for w in words}


@pytest.mark.parametrize(
    ("pattern", "op", "needs"),
    [("hello", "and", ("hel", "ell", "llo")), ("foo|bar", "or", ("foo", "bar")), ("foo.*bar", "and", ("foo", "bar")), (".+error", "and", ("err", "rro", "ror")), ("a{3}", "gram", ("aaa",)), ("[ab]cd", "or", ("acd", "bcd")), ("(abc)+d", "and", ("abc", "bcd"))],
)
def test_regex_plans(pattern, op, needs):
    query = trigrams.of_regex(pattern)
    assert (query.op, query.grams()) == (op, grams(*needs))


@pytest.mark.parametrize("pattern", ["ab", ".*", "(a|bc)d", "x(foo)?y", "[a-z]+", ""])
def test_regex_plans_that_decide_nothing(pattern):
    assert trigrams.of_regex(pattern).op == "all"


def test_literal_plans():
    assert trigrams.literal("hello").grams() == grams("hel", "ell", "llo")
    assert trigrams.literal("a").op == trigrams.literal("").op == "all"
    assert str(trigrams.literal("ab")) == "6162" and str(trigrams.literal("é")) == "C3A9"
    assert str(trigrams.literal("A1", ignore_case=True)) == "or(4131,6131)"
    assert trigrams.literal("hel", ignore_case=True).op == "or"
    assert trigrams.literal("abcdefghijklmnop", ignore_case=True).op == "all"
    assert trigrams.of_regex("skip", ignore_case=True).op == "all"  # s and k fold to letters beyond ASCII


def test_case_variants():
    number = lambda w: next(iter(grams(w)))
    assert [len(trigrams.case_variants(number(w))) for w in ("hel", "h1!", "123")] == [8, 2, 1]


@pytest.mark.parametrize("pattern", ["[invalid", "(a", "a)", "*a", "(?=x)", r"\1", "a{2", "x{3,1}", "(?<!a)b", r"\q", "a{1001}"])
def test_invalid_patterns(pattern):
    with pytest.raises(InvalidPattern):
        regex.parse(pattern)


def test_globs():
    import re

    hit = lambda glob, path: bool(re.match(regex.glob_to_java(glob).replace(r"\z", r"\Z").replace("\\x{", "\\x").replace("}", ""), path))
    assert hit("*.rs", "src/main.rs") and hit("src/**/x?.py", "src/a/b/x1.py") and hit("[!a]b", "cb")
    assert not hit("*.rs", "main.rsx") and not hit("[!a]b", "ab")
    for bad in ("[invalid", "a***b", "a**b"):
        with pytest.raises(InvalidPattern):
            regex.glob_to_java(bad)


def test_durations():
    assert [parse_since(t).phrase for t in ("1h", "30m", "2d", "1w", "0h")] == ["1 hour ago", "30 minutes ago", "2 days ago", "1 week ago", "0 hours ago"]
    assert parse_since("3.commits").commits == 3 and parse_since("3.commits").phrase is None
    for bad in ("abc", "h", "", "x.commits", "-1h", "1.5h"):
        with pytest.raises(InvalidArgument):
            parse_since(bad)


@pytest.mark.parametrize(("pattern", "found"), [(r"foo\|bar", r"\|"), ("(foo|bar)", "(foo|bar)"), (r"\d+", r"\d"), (r"\(x", r"\("), ("[a-z]", "[a-z]"), ("a{2,3}", "{2,3}"), ("(?:x", "(?:"), (r"a\n", r"\n")])
def test_hints(pattern, found):
    assert detect_regex(pattern) == found
    assert found in detect_regex_hint(pattern)


@pytest.mark.parametrize("pattern", [r"\\d", "foo(bar)", "a|b", "[abc]", "{x}", r"\\n", "plain", "array[0]", "fn main()", "$100.00"])
def test_no_hints(pattern):
    assert detect_regex_hint(pattern) is None


def test_file_types():
    assert extensions_for_type("RUST") == ["rs"] and extensions_for_type("py") == ["py", "pyi"] and extensions_for_type("nope") is None
    assert len(list_all_types()) == 34

"""Column functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import ids, query, tokenize
from lattica.schema import VerbError


def values(spark, cases, make, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_id(spark):
    cases = {
        "file:git.corp.example:8443/acme/widgets:cmd/main.go": ("file", "git.corp.example:8443/acme/widgets", "cmd/main.go"),
        "sym:git.example/a/b:x.go#A:B": ("sym", "git.example/a/b", "x.go#A:B"), "repo:git.example/a": ("repo", "git.example/a", None),
        "repo:": (None, None, None), "thing:a:b": (None, None, None), "file:a:": (None, None, None), "file": (None, None, None), "": (None, None, None),
    }
    got = values(spark, cases, lambda x: F.struct(*[c.alias(k) for k, c in ids.parse_id(x).items()]))
    assert [(r["kind"], r["repo"], r["local"]) for r in got] == list(cases.values())


def test_qualify_and_addressable(spark):
    assert values(spark, ["sym:a.go#T.m"], lambda x: ids.qualify(x, F.lit("h.example/a"))) == ["sym:h.example/a:a.go#T.m"]
    assert values(spark, ["h:8443/a/b", "h/a:b", "h/a", ""], ids.addressable) == [True, False, True, False]


@pytest.mark.parametrize("pattern,text,want", [("a/*", "a/b/c", True), ("a?c", "abc", True), ("a?c", "ac", False), ("a.c", "abc", False), ("*", "", True), ("a+b(c)[d]|$^", "a+b(c)[d]|$^", True), ("x\\y", "x\\y", True)])
def test_glob(spark, pattern, text, want):
    assert values(spark, [text], lambda x: ids.glob_matches(F.lit(pattern), x)) == [want]
    assert ids.glob_match_bytes(pattern, text) is want


def test_glob_question_mark_is_a_byte(spark):
    for pattern, text, want in (("a?c", "a\u00e9c", False), ("a??c", "a\u00e9c", True), ("a*c", "a\u00e9c", True), ("\u00e9?", "\u00e9x", True), ("a", "a\n", False), ("??", "\u00e9\u00e9", False)):
        assert values(spark, [text], lambda x: ids.glob_matches(F.lit(pattern), x)) == [want]  # noqa: B023
        assert ids.glob_match_bytes(pattern, text) is want
    assert not ids.glob_match_bytes("?", "é") and ids.glob_match_bytes("??", "é")


def test_dates(spark):
    assert values(spark, ["1970-01-02", "1970-01-01T02:00:00+02:00", "1970-01-01T00:00:05Z", "last tuesday", "1970-13-01", None], ids.parse_since) == [86400, 0, 5, None, None, None]
    assert values(spark, [0, 86399], ids.render_date, "long") == ["1970-01-01T00:00:00Z", "1970-01-01T23:59:59Z"]


def test_go_module(spark):
    assert values(spark, ["// x\nmodule a.example/b // c\ngo 1.22", 'module "q.example"', "go 1.22", "modules x"], ids.go_module) == ["a.example/b", "q.example", None, None]


def test_locator(spark):
    got = values(spark, ["https://Git.Example/A/b.git/", "ssh://x/y", "https://u:p@h/a", "https://h/a/../b", "https://h/"], lambda x: F.struct(*[c.alias(k) for k, c in ids.locator(x).items()]))
    assert [tuple(r) for r in got] == [("https://git.example", "A/b"), (None, None), (None, None), (None, None), (None, None)]


def test_backoff_and_retry(spark):
    assert values(spark, [0, 1, 6, 7, 50], ids.backoff_seconds, "long") == [30, 60, 1920, 3600, 3600]
    assert values(spark, ["120", "1", "Thu, 01 Jan 1970 00:02:00 GMT", "soon", None], lambda x: ids.retry_after(x, F.lit(None).cast("long"), F.lit(0))) == [120, 5, 120, 300, 300]


def test_code_tokens(spark):
    text = "rateLimit HTTPServer snake_case ÄndereXML2Json"
    assert values(spark, [text], tokenize.code_tokens)[0] == ["rate", "limit", "http", "server", "snake", "case", "ändere", "xml2", "json"] == query.split_code(text)
    assert values(spark, ["", "--"], tokenize.whole_tokens) == [[], []]


@pytest.mark.parametrize("text,ok", [("rate limit", True), ("(" * 8 + "a" + ")" * 8, True), ("(" * 9 + "a" + ")" * 9, False), ("a [b TO c]", False), ("IN [a b]", True), ("x:>5", False), ("a->b", True), ("", False), ("x" * 1025, False), ('"{a}"', True)])
def test_guard(text, ok):
    if ok:
        query.guard(text)
    else:
        with pytest.raises(VerbError):
            query.guard(text)


L, G, A, ALL = query.Leaf, query.Group, query.AnyOf, query.Everything


def either(*nodes):
    return G(tuple(("should", x) for x in nodes))


def both(*nodes):
    return G(tuple(("must", x) for x in nodes))


@pytest.mark.parametrize("text,tree", [
    ("rateLimit", either(L("rateLimit"))),
    ("a b", either(L("a"), L("b"))),
    ("a AND b", both(L("a"), L("b"))),
    ("a OR b", either(L("a"), L("b"))),
    ("(alpha OR beta) AND gamma", both(either(L("alpha"), L("beta")), L("gamma"))),
    ("gamma -(alpha beta)", G((("should", L("gamma")), ("must_not", either(L("alpha"), L("beta")))))),
    ("alpha AND beta OR gamma", either(both(L("alpha"), L("beta")), L("gamma"))),
    ("a b AND c d", either(L("a"), both(L("b"), L("c")), L("d"))),
    ("+a b AND -c", G((("must", L("a")), ("should", G((("must", L("b")), ("must_not", L("c")))))))),
    ("NOT a AND b", G((("must_not", L("a")), ("must", L("b"))))),
    ("name:foo terms:foo body:\"a b\"", either(L("foo", "name"), L("foo", "name"), L("a b", "content"))),
    ("(a b)^2 c^0.5 'd e'", either(either(L("a"), L("b"))._replace(boost=2.0), L("c", boost=0.5), L("d e"))),
    ("content: IN [king \"the\"] x", either(A(("king", "the"), "content"), L("x"))),
    ("* -a", G((("should", ALL()), ("must_not", L("a"))))),
    ("a->b Vec<T> x\\:y", either(L("a->b"), L("Vec<T>"), L("x:y"))),
    ("ANDroid ORacle NOTe INto", either(L("ANDroid"), L("ORacle"), L("NOTe"), L("INto"))),
    ("() a", either(G(()), L("a"))),
])
def test_parse_query(text, tree):
    assert query.parse(text) == tree


@pytest.mark.parametrize("text", ["title:alpha", "http://x", "(a", "a)", "a AND", "AND a", "a AND OR b", '"a', "-a", "NOT a", "-a -b", "IN [a b]", "content:IN [a-b]", "content:IN [a", "name:", "a:b:c", '"a b"~2', "+", "NOT"])
def test_parse_refuses(text):
    with pytest.raises(VerbError) as e:
        query.parse(text)
    assert e.value.code == "bad_request"


def test_tokens_of_a_leaf():
    assert L("rateLimit").sought("name") == ("rate", "limit") and L("rateLimit").sought("name_whole") == ("ratelimit",) and L("a B").sought("content_whole") == ("a", "b")
    assert L("File").sought("kind") == ("File",) and L("--").sought("content") == ()
    assert [(x.text, out) for x, out in query.leaves(query.parse("a -(b +c) d"))] == [("a", False), ("b", True), ("c", True), ("d", False)]

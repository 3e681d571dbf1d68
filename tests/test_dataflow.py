"""The build from facts, containment by signatures, discovery's merge and rules that changed."""

import pytest

from lattica.operators import control, dataflow, resolve


def facts(spark, symbols, imports=(), calls=(), methods=(), embeds=(), constrained=()):
    f = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return dataflow.Facts(
        f(symbols, "repo string, path string, name string, pos long, form string"), f(imports, "repo string, path string, import_path string, site long"), f(calls, "repo string, path string, caller_pos long, callee string, site long"),
        f(methods, "repo string, path string, pos long, name string"), f(embeds, "repo string, path string, pos long, name string, site long"), f(constrained, "repo string, path string, pos long"),
    )


SYMBOLS = [("r", "a/x.go", "f", 1, "function"), ("r", "a/x.go", "f", 2, "function"), ("r", "b/y.go", "g", 1, "function"), ("q", "a/x.go", "g", 1, "function"), ("r", "a/t.go", "T", 1, "type"), ("r", "a/i.go", "I", 1, "interface"), ("r", "a/i.go", "J", 2, "interface"), ("q", "a/t.go", "T", 1, "type")]


def test_build_graph(spark):
    built = dataflow.build_graph(facts(
        spark, SYMBOLS, [("r", "a/x.go", "fmt", 3), ("q", "a/x.go", "fmt", 3)], [("r", "a/x.go", 1, "g", 7), ("r", "b/y.go", 1, "f", 8), ("r", "b/y.go", 1, "none", 9), ("q", "a/x.go", 1, "f", 5)],
        [("r", "a/t.go", 1, "m"), ("r", "a/t.go", 1, "n"), ("r", "a/i.go", 1, "m"), ("r", "a/i.go", 2, "n"), ("q", "a/t.go", 1, "m"), ("q", "a/t.go", 1, "n")], [("r", "a/i.go", 2, "I", 4)],
    ))
    edges = built.all_edges().orderBy("repo", "edge_seq").collect()
    assert [(e["repo"], e["src"], e["kind"], e["dst"], e["confidence"]) for e in edges if e["kind"] != "DEFINES"] == [
        ("q", "file:a/x.go", "IMPORTS", "pkg:fmt", 1.0),
        ("r", "sym:a/i.go#J", "EXTENDS", "sym:a/i.go#I", 0.9), ("r", "file:a/x.go", "IMPORTS", "pkg:fmt", 1.0), ("r", "sym:a/x.go#f", "CALLS", "sym:b/y.go#g", 0.9),
        ("r", "sym:b/y.go#g", "CALLS", "sym:a/x.go#f", 0.45), ("r", "sym:b/y.go#g", "CALLS", "sym:a/x.go#f~2", 0.45), ("r", "sym:a/t.go#T", "IMPLEMENTS", "sym:a/i.go#I", 0.5), ("r", "sym:a/t.go#T", "IMPLEMENTS", "sym:a/i.go#J", 0.5),
    ]
    assert [e["kind"] for e in edges if e["repo"] == "r"][:6] == ["DEFINES"] * 6 and built.nodes.count() == 8 + 6 + 2


def test_a_build_with_a_reference_told_twice_fails(spark):
    with pytest.raises(ValueError):
        dataflow.build_graph(facts(spark, SYMBOLS, calls=[("r", "a/x.go", 1, "g", 7), ("r", "a/x.go", 1, "f", 7)]))


def test_signatures(spark):
    m = [(t, n) for t, ns in {1: "ab", 2: "ba", 3: "abc", 4: "c", 5: "a"}.items() for n in ns] + [(1, "a"), (6, None)]
    i = [(f, n) for f, ns in {10: "a", 11: "ab", 12: "ab", 13: "z", 14: "az", 15: "abc"}.items() for n in ns] + [(16, None)]
    found = resolve.matches(spark.createDataFrame(m, "type_id long, name string"), spark.createDataFrame(i, "iface_id long, name string"))
    got = {(r["src"], r["dst"]) for r in found.edges().collect()}
    assert got == {(1, 10), (2, 10), (3, 10), (5, 10), (1, 11), (2, 11), (3, 11), (1, 12), (2, 12), (3, 12), (3, 15)}
    assert found.pairs.count() == 6 and found.edges().count() == len(got)  # {ab} and {ab} of two types each are one


def test_discovery_conflicts(spark):
    listing = [(1, 1, "a/x", "h/a/x", "included"), (1, 1, "a/y", "h/a/y", "excluded"), (1, 1, "a/z", "h/a/z", "included"), (2, 2, "a/x", "h/a/x", "included"), (2, 2, "a/z", "h/a/z", "included"), (2, 2, "b/n", "h/b/n", "discovered")]
    registry = [(7, 1, "a/x", "h/a/x", "excluded"), (8, 1, "a/y", "h/a/y", "included"), (9, 1, "a/gone", "h/a/gone", "included")]
    out = control.discover(spark.createDataFrame(listing, "org_id long, forge_id long, slug string, qualifier string, state string"), spark.createDataFrame(registry, "repo_id long, forge_id long, slug string, qualifier string, state string"), spark.createDataFrame([(2, "a/x"), (2, "b/n"), (2, "left"), (1, "a/x")], "org_id long, slug string"))
    assert {tuple(r) for r in out.collect()} == {
        (1, "a/x", "update", 7, None, None, True, False), (1, "a/y", "update", 8, None, None, False, True), (1, "a/z", "insert", None, None, None, True, False), (2, "a/x", "conflict", 7, None, None, False, False),
        (2, "a/z", "conflict", None, 1, "a/z", False, False), (2, "b/n", "insert", None, None, None, False, False), (2, "b/n", "resolved", None, None, None, False, False), (2, "left", "resolved", None, None, None, False, False), (1, "a/x", "resolved", None, None, None, False, False),
    }


def test_reachable_repositories(spark):
    repos = spark.createDataFrame([(1, "a/x"), (2, "ab/x"), (3, "b/x"), (4, "")], "repo_id long, slug string")
    at = lambda *patterns: {r["repo_id"] for r in control.reachable(repos, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()}
    assert at("a/x") == {1} and at("a*") == {1, 2} and at("b/?", "ab*") == {2, 3} and at("*") == {1, 2, 3, 4} and at() == set()

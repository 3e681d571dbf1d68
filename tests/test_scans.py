"""A graph that isn't written, with its CALLS factorised, against one whose CALLS are edges, and what is made for a question."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import build, graph, resolve
from lattica.plans import fixtures, graph_queries
from tests.test_operators import DECLS, REFS, edges, nodes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("written", [False, True])
def test_factorised_calls_without_layouts(spark, tmp_path, written):
    r = random.Random(7)
    decls = spark.createDataFrame([(f"f{i % 6}", f"d{i % 3}", f"x{i % 4}", f"sym:{i}") for i in range(18)], DECLS)
    refs = spark.createDataFrame([(f"r{i}", f"sym:{r.randrange(18)}", f"f{r.randrange(8)}", f"d{r.randrange(4)}", f"x{r.randrange(5)}", f"l:{i}") for i in range(30)], REFS)
    calls = resolve.references(refs, decls)
    e = edges(spark, [(f"sym:{r.randrange(18)}", f"sym:{r.randrange(18)}", "DEFINES", "syntactic", 1.0, f"p:{i}") for i in range(20)])
    e = e.withColumn("edge_seq", F.when(F.col("location") != "p:3", F.col("edge_seq")).otherwise("DEFINES\x01\x01own"))  # an order of its own
    n = nodes(spark, [f"sym:{i}" for i in range(18)])
    full = e.unionByName(calls.edges().withColumn("edge_seq", graph.sequence()).select(e.columns))
    got = graph.write(n, e, f"file://{tmp_path}", parts=3, calls=calls) if written else graph.plain(n, e, calls)
    want = graph.plain(n, full)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(got.edges) == rows(want.edges.select(graph.EDGE))
    for ask in (graph.edge_summary, lambda g, of: graph.counts(g, of).where("outs + ins > 0"), graph.incident_edges, lambda g, of: graph.incident_edges(g, of, 3)):
        assert rows(ask(got, n)) == rows(ask(want, n))
    one = n.where("id = 'sym:3'")
    for kinds in (None, ["CALLS"], ["DEFINES"]):
        a, b = (graph.discover(g, one, depth=3, kinds=kinds, budget=50) for g in (got, want))
        assert rows(a.seen) == rows(b.seen) and rows(a.examined) == rows(b.examined) and a.spent == b.spent
    page = graph.page(a.seen, 5)
    assert rows(graph.page_edges(got, a.seen, page)) == rows(graph.page_edges(want, a.seen, page))


def test_a_question_makes_only_the_kinds_that_it_reads(spark):
    app = spark.sparkContext.applicationId
    for kept in (fixtures._graphs, fixtures._edges, fixtures._references):
        kept.clear()
    assert graph_queries.g_node(spark, SF).count() == 1 and graph_queries.g_hydrate(spark, SF).count() == 50
    assert not fixtures._graphs and not fixtures._edges
    graph_queries.h_history(spark, SF)
    graph_queries.g_budget(spark, SF).collect()
    assert {k for a, _, k in fixtures._edges if a == app} == {"TOUCHES", "AUTHORED", "IMPORTS"} and not fixtures._references and not fixtures._graphs


def test_conflicts_group_only_the_identities_that_may_have_any(spark, monkeypatch):
    one, nan = ("a", "b", "CALLS", "syntactic", 0.9, None), float("nan")
    rows = [one, one, ("a", "b", "CALLS", "syntactic", 0.5, "f:1"), ("c", "b", "CALLS", "syntactic", nan, None), ("c", "b", "CALLS", "syntactic", nan, None)]
    rows += [("d", "b", "CALLS", "syntactic", 0.0, None), ("d", "b", "CALLS", "syntactic", -0.0, None), ("e", "b", "CALLS", None, 0.1, None), ("e", "b", "CALLS", "precise", 0.2, None)]
    rows += [("f", "b", "CALLS", "precise", 0.2, None), ("f", "b", "CALLS", "inferred", 0.2, None), ("g", "b", "CALLS", "made up", 0.2, None), ("g", "b", "CALLS", "made too", 0.2, None), ("g", "b", "CALLS", "made up", 0.3, None)]
    rows += [("h", "b", "CALLS", "made up", 0.2, None), ("h", "b", "CALLS", "made up", 0.2, None), ("i", None, "CALLS", "precise", 0.2, "x"), ("i", None, "CALLS", "precise", nan, "x")]
    kept, settle = {}, build.settle
    monkeypatch.setattr(build, "settle", lambda df, what: kept.setdefault(what, settle(df, what)))
    e = edges(spark, rows)
    want = e.groupBy(*build.IDENTITY).agg(F.count_distinct("provenance", "confidence").alias("n")).where("n > 1")
    told = lambda df: sorted(map(str, df.collect()))
    assert told(build.edge_conflicts(e)) == told(want) and want.count() == 3
    assert kept["hashes"].count() == len(rows) - 1 and kept["conflicts"].count() == 4  # f, g, i, and h, whose provenance isn't known

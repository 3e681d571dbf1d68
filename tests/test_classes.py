"""Candidates by class: what is made before the last join grows with references and declarations, not with their product."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import build, resolve
from lattica.plans import catalog
from tests.test_operators import DECLS, REFS


def test_methods_by_name_are_factorised(spark):
    decls = spark.createDataFrame([(f"f{i}", "a", f"m{i % 2}" if i < 60 else None, f"s{i:02}") for i in range(64)], DECLS)
    refs = spark.createDataFrame([(f"r{i}", "c", "f", "a", ["m0", "m1", "none", None][i % 4], f"l:{i}") for i in range(40)], REFS)
    found = resolve.methods_by_name(refs, decls.select("name", "symbol_id"))
    assert found.refs.count() == 20 and found.members.count() == 60 and {r["n"] for r in found.refs.collect()} == {30}
    got = sorted(map(tuple, resolve.resolve_methods(refs, decls).select("location", "dst", "confidence").collect()))
    assert got == sorted((f"l:{i}", f"s{j:02}", 0.9 / 30) for i in range(40) if i % 4 < 2 for j in range(60) if j % 2 == i % 4)


def test_imported_names_expand_last(spark):
    decls = spark.createDataFrame([("f1", "a", "x", "s1"), ("f1", "a", "x", "s1"), ("f2", "b", "x", "s2"), ("f3", "b", "x", "s3"), ("f3", "b", "y", "s4"), ("f5", "b", "x", "s1")], DECLS)
    rows = [("r1", "c", "l:1", "p", "x"), ("r1", "c", "l:1", "p", "x"), ("r2", "c", "l:2", "q", "y"), ("r3", "c", "l:3", "q", "z"), ("r4", "c", None, "q", "x"), ("r5", "c", "l:5", None, "x")]
    refs = spark.createDataFrame(rows, "ref_id string, caller_id string, location string, import_path string, callee string")
    dirs = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b"), ("q", "b")], "import_path string, dir string")
    found = resolve.resolve_imported(refs, dirs, decls)
    got = sorted((str(r["location"]), r["dst"], r["confidence"]) for r in found.collect())
    assert got == sorted([("l:1", s, 0.9 / 3) for s in ("s1", "s2", "s3")] + [("l:2", "s4", 0.9)] + [("None", s, 0.9 / 3) for s in ("s1", "s2", "s3")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Join") < plan.index("Aggregate")  # nothing is grouped behind the join that makes candidates


@pytest.fixture
def unexpanded(monkeypatch):
    def expand(*_, **__):
        raise AssertionError("calls are expanded")

    monkeypatch.setattr(resolve.References, "edges", expand)


def test_confidences_expand_nothing(spark, unexpanded):
    told = catalog.QUERIES["x_spread_confidence"](spark, "/root/testdata/sf0.001").agg(F.sum("n").alias("n"), F.count_distinct("ref_id").alias("d"), F.count("ref_id").alias("c")).first()
    assert told["n"] > told["c"] == told["d"] > 0


def test_counts_expand_nothing(spark, unexpanded):
    n = catalog.QUERIES["x_counts"](spark, "/root/testdata/sf0.001").first()
    assert n["nodes"] > 0 and n["edges"] > 0
    none = spark.range(0).selectExpr("'' AS cls", "'' AS symbol_id", "1L AS n")
    assert build.counts(spark.range(2), spark.range(3), resolve.References(none, none)).first()[:] == (2, 3)
    some = none.unionByName(spark.range(4).selectExpr("'a' AS cls", "'b' AS symbol_id", "5L AS n"))
    assert build.counts(spark.range(2), spark.range(3), resolve.References(some, none)).first()[:] == (2, 23)

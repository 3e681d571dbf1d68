"""CALLS that are published as they were resolved."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import graph, search, verbs
from lattica.operators.resolve import References
from lattica.sources import files
from tests.test_operators import edges, nodes

REPO = "h.example/a"


def references(spark, refs, members):
    sizes = {c: len([1 for k, _ in members if k == c]) for _, c, _ in refs}
    rows = [(f"r{i}", who, at, c, sizes[c], 0.9 / sizes[c]) for i, (who, c, at) in enumerate(refs)]
    return References(spark.createDataFrame(rows, "ref_id string, caller_id string, location string, cls string, n long, confidence double"), spark.createDataFrame(members, "cls string, symbol_id string"))


def test_calls_stay_factorised(spark, tmp_path):
    store, n = files.Store(spark, f"file://{tmp_path}"), nodes(spark, ["file:a", *[f"sym:{i}" for i in range(40)]]).withColumn("repo", F.lit(REPO))
    e, docs = edges(spark, [("file:a", "sym:0", "DEFINES")]), search.search_docs(n, spark.createDataFrame([("file:a", "x")], "node_id string, content string"))
    calls = references(spark, [(f"sym:{i}", "c", f"a:{i}") for i in range(40)], [("c", f"sym:{i}") for i in range(40)])
    m = store.publish(7, "c" * 40, n, e, docs, calls=calls)
    rev = store.revision("c" * 40, "syntactic")
    assert m["counts"]["edges"] == 1 + 40 * 40 and len(m["segments"]) == 5 and store.published(7, "c" * 40, contents=True) == m
    at = f"file://{tmp_path}/shards/7/{rev}/{m['attempt']}/edges"
    assert sum(spark.read.parquet(f"{at}/{x}").count() for x in ("rows", "references", "members")) == 1 + 40 + 40
    want = e.unionByName(calls.edges().withColumn("edge_seq", graph.sequence()).select(e.columns))
    assert sorted(map(str, store.read(7, rev, "edges").select(e.columns).collect())) == sorted(map(str, want.collect()))
    assert store.point(7, rev, 0, fence=1)
    engine = verbs.Engine(verbs.Catalog.of(store, {7: REPO}), b"key")
    assert {r["id"] for r in engine.neighbors(f"sym:{REPO}:3").rows.collect()} == {f"sym:{i}" for i in range(40)} - {"sym:3"}


def test_calls_that_clash(spark, tmp_path):
    store, n = files.Store(spark, f"file://{tmp_path}"), nodes(spark, ["file:a", "sym:0", "sym:1"]).withColumn("repo", F.lit(REPO))
    e, docs = edges(spark, [("file:a", "sym:0", "DEFINES")]), search.search_docs(n, spark.createDataFrame([("file:a", "x")], "node_id string, content string"))
    members = [("c", "sym:0"), ("c", "sym:1"), ("d", "sym:1"), ("e", "sym:0")]
    for refs, clash in (([("sym:0", "c", "a:1"), ("sym:0", "d", "a:1")], True), ([("sym:0", "e", "a:1"), ("sym:0", "d", "a:1")], False), ([("sym:0", "c", None), ("sym:1", "d", None)], False)):
        calls = references(spark, refs, members)
        commit = f"{len(refs)}{int(clash)}{refs[0][1]}".ljust(40, "0")
        if clash:
            with pytest.raises(ValueError, match="derivation"):
                store.publish(1, commit, n, e, docs, calls=calls)
            assert store.published(1, commit) is None
        else:
            assert store.publish(1, commit, n, e, docs, calls=calls)["counts"]["edges"] == 1 + calls.edges().count()


def test_an_order_that_follows_is_not_written(spark, tmp_path):
    store, n = files.Store(spark, f"file://{tmp_path}"), nodes(spark, ["file:a", "sym:0", "sym:1"]).withColumn("repo", F.lit(REPO))
    e, docs = edges(spark, [("file:a", "sym:0", "DEFINES"), ("file:a", "sym:1", "DEFINES")]), search.search_docs(n, spark.createDataFrame([("file:a", "x")], "node_id string, content string"))
    e = e.withColumn("edge_seq", F.when(F.col("dst") == "sym:0", "own").otherwise(graph.sequence()))
    m, rev = store.publish(7, "c" * 40, n, e, docs), store.revision("c" * 40, "syntactic")
    assert {(r["dst"], r["edge_seq"]) for r in spark.read.parquet(f"file://{tmp_path}/shards/7/{rev}/{m['attempt']}/edges").collect()} == {("sym:0", "own"), ("sym:1", None)}
    assert sorted(map(str, store.read(7, rev, "edges").select(e.columns).collect())) == sorted(map(str, e.collect()))

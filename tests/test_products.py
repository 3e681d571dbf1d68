"""Products of few keys with many rows each."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import build, dataflow, resolve
from lattica.plans import build_queries


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(resolve, "TASK_ROWS", 500)
    monkeypatch.setattr(resolve, "BLOCK", 10)


def test_one_key_is_dealt_to_many_tasks(spark, small):
    left = spark.range(100).select(F.when(F.col("id") < 90, "a").when(F.col("id") < 99, "b").alias("k"), F.col("id").alias("x"))
    right = spark.range(70).select(F.when(F.col("id") < 60, "a").otherwise("b").alias("k"), (F.col("id") % 50).alias("y"))
    got = resolve.product(left, right, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 90 * 60 / 2


def test_imports_of_files_in_several_directories(spark, small):
    imports = spark.createDataFrame([(f"f{i}", p) for i in range(60) for p in ("one", "two", "three")] + [(None, "one")], "file_id string, import_path string")
    dirs = spark.createDataFrame([("one", "x"), ("two", "x"), ("two", "y"), ("three", "y"), ("three", "x")], "import_path string, dir string")
    where = [(f"f{i}", d) for i in range(60) for d in (["x"], ["y"], ["x", "y"], ["z"])[i % 4]] + [("f0", "x"), (None, "x"), ("f7", None)]
    found = resolve.import_edges(imports, dirs, spark.createDataFrame(where, "file_id string, dir string")).select("src", "dst", "confidence")
    n = {"one": 1, "two": 2, "three": 2}
    want = {(f, g, 0.9 / n[p]) for f, p in {tuple(r) for r in imports.collect()} for q, d in {tuple(r) for r in dirs.collect()} if p == q for g, at in where if at == d and f and g and f != g}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_calls_of_a_build_are_made_in_blocks(spark, monkeypatch):
    built = dataflow.build_graph(build_queries.facts(spark, "/root/testdata/sf0.001"))
    keys, product = [], resolve.product
    monkeypatch.setattr(resolve, "product", lambda left, right, key: keys.append(key) or product(left, right, key))
    monkeypatch.setattr(resolve, "TASK_ROWS", 2000)
    monkeypatch.setattr(resolve, "BLOCK", 3)
    told = ("repo", "src", "dst", "location", "confidence", "edge_seq")
    got = sorted(tuple(r[c] for c in told) for r in built.all_edges().where("kind = 'CALLS'").collect())
    want = []
    for r in built.calls.edges().collect():
        (repo, src), (_, dst), (path, site) = r["src"].split("\x02"), r["dst"].split("\x02"), r["location"].rsplit(":", 1)
        want.append((repo, src, dst, r["location"], r["confidence"], "\x01".join(("1", path, "1", site.zfill(12), src, dst))))
    assert got == sorted(want) and len(got) > 2000 and "cls" in keys


def test_calls_of_one_name_are_dealt_to_many_tasks(spark, small):
    decls = spark.createDataFrame([(f"f{i}", "a", "m", f"s{i:02}") for i in range(60)] + [("g", "b", "n", "t")], "file_id string, dir string, name string, symbol_id string")
    refs = spark.createDataFrame([(f"r{i}", f"c{i}", "f", "a", "m", f"l:{i}", "p") for i in range(90)] + [("r", "c", "f", "x", "n", None, "p")], "ref_id string, caller_id string, file_id string, dir string, callee string, location string, import_path string")
    many = {(f"c{i}", f"s{j:02}", f"l:{i}", 0.9 / 60) for i in range(90) for j in range(60)}
    dirs = spark.createDataFrame([("p", "a"), ("p", "b")], "import_path string, dir string")
    for found in (resolve.resolve_tiers(refs, decls), resolve.resolve_imported(refs, dirs, decls), resolve.resolve_methods(refs, decls)):
        rows = [tuple(r) for r in found.select("src", "dst", "location", "confidence").collect()]
        assert len(rows) == 90 * 60 + 1 and set(rows) == many | {("c", "t", None, 0.9)}
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 4 and max(r["count"] for r in tasks) < 90 * 60 / 2


def test_calls_are_emitted_in_blocks(spark, small):
    none = spark.createDataFrame([("f", 3, "f", "pkg:x", None)], "path string, site int, src string, dst string, location string")
    refs = spark.createDataFrame([("f", i, f"c{i}", f"f:{i}", "k", 60, 0.015) for i in range(90)], "path string, site int, caller_id string, location string, cls string, n int, confidence double")
    members = spark.createDataFrame([("k", f"s{j:02}") for j in range(60)], "cls string, symbol_id string")
    found = build.emit(none, resolve.References(refs, members))
    got = sorted(tuple(r) for r in found.select("src", "dst", "location", "edge_seq").collect() if r["dst"] != "pkg:x")
    assert got == sorted((f"c{i}", f"s{j:02}", f"f:{i}", f"001\x01f\x01{i:010}\x01s{j:02}") for i in range(90) for j in range(60))
    assert [r["edge_seq"] for r in found.where("dst = 'pkg:x'").collect()] == ["000\x01f\x010000000003\x01pkg:x"]
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 90 * 60 / 2

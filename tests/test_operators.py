"""Operators on hand-made graphs, histories, queues and sources."""

import random
import subprocess
from collections import deque
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.functions.query import parse
from lattica.operators import build, control, graph, history, postings, resolve, search
from lattica.schema import VerbError
from lattica.sources import extract, files
from lattica.sources import git as repositories
from lattica.streaming import stateful

EDGE = "src string, dst string, kind string, provenance string, confidence double, location string"


def edges(spark, rows):
    full = [(*r, "syntactic", 1.0, None)[:6] if len(r) == 3 else r for r in rows]
    return spark.createDataFrame(full, EDGE).withColumn("edge_seq", F.concat_ws("\x01", "kind", "src", "dst", F.coalesce("location", F.lit(""))))


def nodes(spark, names):
    return spark.createDataFrame([(n, "File", n, n, None) for n in names], "id string, kind string, name string, path string, committed_at long")


@pytest.mark.parametrize("written", [False, True])
def test_neighbors(spark, tmp_path, written):
    e = edges(spark, [("file:a", "file:b", "IMPORTS"), ("file:b", "file:c", "IMPORTS"), ("file:d", "file:a", "CALLS"), ("file:a", "file:a", "CALLS")])
    n = nodes(spark, [f"file:{x}" for x in "abcd"])
    g = graph.write(n, e, f"file://{tmp_path}", parts=3) if written else graph.plain(n, e)
    assert g.parts == (3 if written else None) and sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, e.select(graph.EDGE).collect()))
    summary = {(r["direction"], r["kind"]): (r["count"], r["provenance"]) for r in graph.edge_summary(g, graph.node(g, "file:a")).collect()}
    assert summary == {("out", "IMPORTS"): (1, {"syntactic": 1}), ("out", "CALLS"): (1, {"syntactic": 1}), ("in", "CALLS"): (2, {"syntactic": 2})}
    ids_of = lambda **k: [r["id"] for r in graph.neighbors(g, "file:a", **k).orderBy("rank").collect()]
    assert ids_of() == ["file:b", "file:d"]
    assert ids_of(direction="out", depth=2) == ["file:b", "file:c"]
    assert ids_of(direction="in", depth=3) == ["file:d"]
    assert ids_of(kinds=["CALLS"]) == ["file:d"]
    assert ids_of(depth=2, limit=1, after=(1, "file:b")) == ["file:d"]
    assert ids_of(depth=2, after=(1, "file:bb")) == ["file:d", "file:c"]
    for bad in ({"direction": "up"}, {"kinds": []}, {"kinds": ["X"]}, {"depth": 4}, {"limit": 0}):
        with pytest.raises(VerbError):
            graph.neighbors(g, "file:a", **bad)
    lacking = graph.plain(n.where("id <> 'file:b'"), e)
    with pytest.raises(Exception, match="missing"):
        graph.neighbors(lacking, "file:a").collect()


def test_hub(spark):
    e = edges(spark, [("hub", f"n{i:05d}", "IMPORTS") for i in range(1001)])
    hub = spark.createDataFrame([("hub",)], "id string")
    got = graph.incident_edges(graph.plain(hub, e), hub).collect()
    assert len(got) == 1000 and all(r["capped"] for r in got) and max(r["dst"] for r in got) == "n00999"
    assert not any(r["capped"] for r in graph.incident_edges(graph.plain(hub, e.where("dst <> 'n00000'")), hub).collect())


def test_budget(spark):
    e = edges(spark, [("file:o", f"file:{i}", "IMPORTS") for i in range(30)])
    n = nodes(spark, ["file:o"])
    found = graph.discover(graph.plain(n, e), n, budget=10)
    assert found.seen.count() == 11 and found.examined.count() == 10 and found.spent
    found = graph.discover(graph.plain(n, e), n, depth=2, budget=30)
    assert found.seen.count() == 31 and found.examined.count() == 30 and found.spent  # the leaves' edges are beyond it
    assert not graph.discover(graph.plain(n, e), n, depth=2, budget=60).spent


def brute_reach(rows, origin, depth, budget, cap):
    """Nodes with depths, the examined edges in order, and whether the budget was spent, by loops."""
    seen, frontier, looked, spent = {origin: 0}, [origin], [], False
    for level in range(1, depth + 1):
        found = []
        for x in sorted(frontier):
            near = sorted((r for r in rows if x in r[:2]), key=lambda r: (r[2], r[0], r[1], r[5] or ""))[:cap]
            for r in sorted(near, key=lambda r: (r[0], r[1], r[2], r[5] is not None, r[5] or "")):
                if len(looked) == budget:
                    spent = True
                    continue
                looked.append((level, *r[:3], r[5]))
                found.append(r[1] if r[0] == x else r[0])
        frontier = [x for x in dict.fromkeys(found) if x not in seen]
        seen.update(dict.fromkeys(frontier, level))
    return seen, looked, spent


@pytest.mark.parametrize("budget,written", [(10_000, False), (60, False), (60, True), (25, False)])
def test_discover_and_page_edges(spark, tmp_path, budget, written):
    r = random.Random(budget)
    rows = list({(f"file:{r.randrange(40)}", f"file:{int(40 * r.random() ** 2)}", r.choice(["CALLS", "IMPORTS"]), "syntactic", 1.0, r.choice([None, "a:1", "b:2"])): 0 for _ in range(120)})
    e, n = edges(spark, rows), nodes(spark, [f"file:{i}" for i in range(40)])
    g = graph.write(n, e, f"file://{tmp_path}", parts=4) if written else graph.plain(n, e)
    found = graph.discover(g, graph.node(g, "file:1"), depth=3, budget=budget)
    seen, looked, spent = brute_reach(rows, "file:1", 3, budget, 1000)
    assert {x["id"]: x["depth"] for x in found.seen.collect()} == seen and found.spent == spent
    assert [(x["level"], x["src"], x["dst"], x["kind"], x["location"]) for x in found.examined.orderBy("n").collect()] == looked
    rank = {x: i for i, (_, x) in enumerate(sorted((d, x) for x, d in seen.items()))}
    for after, span in ((None, range(1, 6)), ((1, sorted(x for x in seen if seen[x] == 1)[0]), range(2, 7))):
        paged = graph.page(found.seen, 5, after)
        got = sorted((x["edge_seq"], x["rank"]) for x in graph.page_edges(g, found.seen, paged).collect())
        want = [(max(1, rank[x[0]], rank[x[1]]), x) for x in rows if x[0] in rank and x[1] in rank]
        assert got == sorted(("\x01".join([x[2], x[0], x[1], x[5] or ""]), k) for k, x in want if k in span)


def test_page_edges(spark):
    e = edges(spark, [("file:a", "file:b", "IMPORTS"), ("file:b", "file:c", "IMPORTS"), ("file:a", "file:a", "CALLS"), ("file:a", "file:c", "CALLS")])
    g = graph.plain(nodes(spark, ["file:a"]), e)
    seen = graph.discover(g, g.nodes, depth=1).seen
    first, second = graph.page(seen, 1), graph.page(seen, 1, (1, "file:b"))
    got = lambda p: {(r["src"], r["dst"]) for r in graph.page_edges(g, seen, p).collect()}
    assert got(first) == {("file:a", "file:b"), ("file:a", "file:a")} and got(second) == {("file:b", "file:c"), ("file:a", "file:c")}


def test_edge_integrity(spark):
    same = ("a", "b", "CALLS", "syntactic", 0.9, None)
    e = edges(spark, [same, same, ("a", "b", "CALLS", "syntactic", 0.9, "f:1:1"), ("c", "b", "CALLS", "syntactic", 0.9, None), ("c", "b", "CALLS", "syntactic", 0.45, None)])
    assert build.dedup_edges(e).count() == 4
    assert [r["src"] for r in build.edge_conflicts(e).collect()] == ["c"]
    assert {r["id"] for r in build.dangling(e, spark.createDataFrame([("a",), ("b",)], "id string")).collect()} == {"c"}


DECLS = "file_id string, dir string, name string, symbol_id string"
REFS = "ref_id string, caller_id string, file_id string, dir string, callee string, location string"


def test_resolution(spark):
    d = spark.createDataFrame([("f1", "a", "x", "s1"), ("f2", "a", "x", "s2"), ("f3", "b", "x", "s3"), ("f3", "b", "y", "s4"), ("f4", "c", "y", "s5")], DECLS)
    r = spark.createDataFrame([("1", "c1", "f1", "a", "x", "l1"), ("2", "c2", "f9", "a", "x", "l2"), ("3", "c3", "f9", "z", "y", "l3"), ("4", "c4", "f9", "z", "none", "l4")], REFS)
    got = {(x["src"], x["dst"], x["confidence"]) for x in resolve.resolve_tiers(r, d).collect()}
    assert got == {("c1", "s1", 0.9), ("c2", "s1", 0.45), ("c2", "s2", 0.45), ("c3", "s4", 0.45), ("c3", "s5", 0.45)}
    assert resolve.resolve_tiers(r, d, repo_wide=F.lit(False)).where("src = 'c3'").count() == 0


def test_longest_prefix_keeps_ties(spark):
    i = spark.createDataFrame([("f", "m.example/a/b"), ("f", "m.example/ab"), ("f", "m.example")], "file_id string, import_path string")
    m = spark.createDataFrame([("m.example", ""), ("m.example/a", "x"), ("m.example/a", "y")], "module string, root string")
    assert {tuple(r) for r in resolve.import_dirs(i, m).collect()} == {("m.example/a/b", "x/b"), ("m.example/a/b", "y/b"), ("m.example/ab", "ab"), ("m.example", "")}


def test_division_and_closure(spark):
    m = spark.createDataFrame([("T", "a"), ("T", "b"), ("U", "a")], "type_id string, name string")
    i = spark.createDataFrame([("I", "a"), ("J", "a"), ("J", "b")], "iface_id string, name string")
    assert {(r["src"], r["dst"]) for r in resolve.implements(m, i).collect()} == {("T", "I"), ("T", "J"), ("U", "I")}
    direct = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("X", "x"), ("Y", "y")], "iface_id string, name string")
    embeds = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "X"), ("X", "Y"), ("Y", "X")], "iface_id string, embedded string")
    none = spark.createDataFrame([], "iface_id string")
    got = {tuple(r) for r in resolve.interface_closure(direct, embeds, none).collect()}
    assert got == {("A", "a"), ("A", "b"), ("A", "c"), ("B", "b"), ("B", "c"), ("C", "c")}
    assert {r["iface_id"] for r in resolve.interface_closure(direct, embeds, spark.createDataFrame([("C",)], "iface_id string")).collect()} == set()


def test_history_from_git(spark, tmp_path):
    git = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, **k)
    git("init", "-q")
    for i, (name, email) in enumerate([("A", "a@x"), ("A2", " a@x "), ("B", "b@x")]):
        (tmp_path / "f.txt").write_text(str(i))
        (tmp_path / f"é {i}.txt").write_text("x")
        git("add", "-A")
        when = f"{1_000_001_000 + 1000 * (i > 1)} +0000"
        env = {"GIT_AUTHOR_NAME": name, "GIT_AUTHOR_EMAIL": email, "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path)}
        git("commit", "-q", "-m", f"subject {i}", env=env)
    git("-c", "user.name=c", "-c", "user.email=c@x", "commit", "-q", "--allow-empty", "-m", "empty")
    commits = repositories.git_log(spark, str(tmp_path))
    rows = commits.collect()
    assert [r["subject"] for r in rows] == ["empty", "subject 2", "subject 1", "subject 0"] and rows[0]["paths"] == [] and rows[1]["paths"] == ["f.txt", "é 2.txt"]
    n, e = build.history_graph(commits)
    n = n.withColumn("path", F.lit(None).cast("string"))
    g = graph.plain(n, e.withColumn("edge_seq", F.concat_ws(" ", "kind", "src", "dst")))
    page = history.history(g, "file:f.txt").orderBy(F.desc("committed_at"), "id").collect()
    assert [r["committed_at"] for r in page] == [1_000_002_000, 1_000_001_000, 1_000_001_000] and page[0]["author_name"] == "B" and page[1]["id"] < page[2]["id"]
    rest = history.history(g, "file:f.txt", after=(page[1]["committed_at"], page[1]["id"])).collect()
    assert [r["id"] for r in rest] == [page[2]["id"]]


def test_rules(spark):
    repos = spark.createDataFrame([(1, "acme/a", "public"), (2, "acme/b", "private"), (3, "zzz/c", "private"), (4, "zzz/d", "internal")], "repo_id long, slug string, visibility string")
    rules = spark.createDataFrame([(1, "acme/*", "include", False, 1), (2, "acme/?", "exclude", False, 2), (3, "acme/*", "exclude", True, 0)], "rule_id long, pattern string, action string, applies_to_private boolean, created_at long")
    got = {r["repo_id"]: (r["rule_id"], r["state"]) for r in control.rule_precedence(repos, rules).collect()}
    assert got == {1: (2, "excluded"), 2: (3, "excluded"), 3: (None, "discovered"), 4: (None, "included")}


def test_token_bucket():
    b = stateful.Bucket(60)
    assert all(b.take(0, 1)[0] for _ in range(60)) and b.take(0, 1) == (False, 1.0)
    assert b.take(1, 1)[0] and not b.take(1, 1)[0]
    b = stateful.Bucket(60)
    b.cool(0, 30)
    assert b.take(0, 60) == (False, 90.0)
    b.cool(1, 5)
    assert b.cooldown == 30


def test_sliding_limiter(spark):
    rows = [(w, float(t), i) for i, (w, t) in enumerate([(1, 0), (1, 1), (1, 2), (1, 9.5), (1, 10), (1, 11), (2, 3), (1, 11)])]
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in stateful.sliding_limiter(spark.createDataFrame(rows, "credential long, ts double, id long"), 2, 10.0).collect()}
    want, seen = {}, {}
    for w, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        q = seen.setdefault(w, deque())
        while q and q[0] <= t - 10:
            q.popleft()
        want[i] = (len(q) < 2, 0.0 if len(q) < 2 else 10 - (t - q[0]))
        if len(q) < 2:
            q.append(t)
    assert got == want


def test_streaming_bucket_agrees_with_batch(spark, tmp_path):
    rows = [(f"f{i % 3}", float(i), i, float(i % 7), 20.0 if i % 41 == 0 else None) for i in range(200)]
    schema = "forge string, ts double, id long, need double, cool double"
    df = spark.createDataFrame(rows, schema)
    for k in range(2):
        df.where((F.col("id") >= 100) == bool(k)).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.stream_token_bucket(stream, 10.0).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: r["granted"] for r in spark.table("bucket").collect()}
    assert got == {r["id"]: r["granted"] for r in stateful.token_bucket(df, 10.0).collect()}


def test_publish(spark, tmp_path):
    store = files.Store(spark, f"file://{tmp_path}")
    n = nodes(spark, ["file:a"]).withColumn("repo", F.lit("r"))
    e, docs = edges(spark, [("file:a", "file:b", "IMPORTS")]), search.search_docs(n, spark.createDataFrame([("file:a", "hello world")], "node_id string, content string"))
    m = store.publish(7, "c" * 40, n, e, docs)
    rev = store.revision("c" * 40, "syntactic")
    assert m["counts"] == {"nodes": 1, "edges": 1} and store.published(7, "c" * 40) == m and store.index(7, rev).blocks.where("field = 'content'").count() == 2
    assert store.publish(7, "c" * 40, n.limit(0), e, docs) == m
    at = tmp_path / "shards/7" / rev / m["attempt"]
    part = next((at / "nodes").glob("part-*.parquet"))
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own check
    raw = bytearray(part.read_bytes())
    raw[10] ^= 1  # of equal length
    part.write_bytes(raw)
    assert store.published(7, "c" * 40, contents=True) is None and store.published(7, "c" * 40) == m  # lengths alone don't tell
    raw[10] ^= 1
    part.write_bytes(raw)
    assert store.published(7, "c" * 40, contents=True) == m
    part.write_bytes(raw[:-1])
    assert store.published(7, "c" * 40) is None
    part.write_bytes(raw)
    assert {r["node_id"] for r in search.search(store.index(7, rev), "hello").collect()} == {"file:a"}
    subprocess.run(["rm", "-r", str(at / "edges")], check=True)
    assert store.published(7, "c" * 40) is None
    store.delete(7, rev)
    with pytest.raises(FileNotFoundError):
        store.read(7, rev, "nodes")
    with pytest.raises(ValueError):
        store.publish(8, "d" * 40, n, e.unionByName(e.withColumn("confidence", F.lit(0.5))), docs)


def test_two_publishers(spark, tmp_path):
    """Both begin before either has ended; the one that is last loses, and the winner's segments stay whole."""
    first, second = files.Store(spark, f"file://{tmp_path}"), files.Store(spark, f"file://{tmp_path}")
    n = nodes(spark, ["file:a"]).withColumn("repo", F.lit("r"))
    e, docs, won = edges(spark, [("file:a", "file:b", "IMPORTS")]), search.search_docs(n, spark.createDataFrame([("file:a", "x")], "node_id string, content string")), []

    def meanwhile():  # the second has written its segments; now the first publishes
        won.append(first.publish(1, "e" * 40, n, e, docs))
        return True

    got = second.publish(1, "e" * 40, n.limit(0), e, docs, wanted=meanwhile)
    assert got == won[0] and got["counts"]["nodes"] == 1 and first.published(1, "e" * 40) == got
    rev = first.revision("e" * 40, "syntactic")
    assert first.read(1, rev, "nodes").count() == 1 and len([x for x in (tmp_path / "shards/1" / rev).iterdir() if x.name.startswith("attempt-")]) == 1
    assert first.publish(2, "f" * 40, n, e, docs, wanted=lambda: False) is None and first.manifest(2, first.revision("f" * 40, "syntactic")) is None


class Dies(BaseException):
    """A publisher that is killed."""


@pytest.mark.parametrize("step", ["segments", "index", "counts", "digests", "draft", "after the draft"])
def test_a_publisher_that_dies_blocks_nobody(spark, tmp_path, monkeypatch, step):
    store, n = files.Store(spark, f"file://{tmp_path}"), nodes(spark, ["file:a"]).withColumn("repo", F.lit("r"))
    e, docs = edges(spark, [("file:a", "file:b", "IMPORTS")]), search.search_docs(n, spark.createDataFrame([("file:a", "x")], "node_id string, content string"))
    rev = store.revision("a" * 40, "syntactic")

    def dies(*_, **__):
        raise Dies

    with monkeypatch.context() as m:
        if step == "segments":
            m.setattr(files.build, "edge_conflicts", dies)
        elif step == "index":
            m.setattr(files.postings, "build", dies)
        elif step == "counts":
            m.setattr(files.build, "counts", dies)
        elif step == "digests":
            m.setattr(files.Store, "_digests", dies)
        elif step == "draft":
            m.setattr(files.Store, "put", dies)
        else:
            m.setattr(files.os, "link", dies)
        with pytest.raises(Dies):
            store.publish(1, "a" * 40, n, e, docs)
    assert store.manifest(1, rev) is None and store.published(1, "a" * 40) is None
    done = store.publish(1, "a" * 40, n, e, docs)
    assert store.published(1, "a" * 40, contents=True) == done and done["counts"]["nodes"] == 1


@pytest.mark.parametrize("torn", ["", '{"commit": "aa', "[]", "null"])
def test_a_torn_manifest_is_none(spark, tmp_path, torn):
    store, n = files.Store(spark, f"file://{tmp_path}"), nodes(spark, ["file:a"]).withColumn("repo", F.lit("r"))
    e, docs = edges(spark, [("file:a", "file:b", "IMPORTS")]), search.search_docs(n, spark.createDataFrame([("file:a", "x")], "node_id string, content string"))
    at = tmp_path / "shards/1" / store.revision("a" * 40, "syntactic")
    at.mkdir(parents=True)
    (at / "manifest.json").write_text(torn)
    assert store.published(1, "a" * 40) is None
    done = store.publish(1, "a" * 40, n, e, docs)
    assert store.published(1, "a" * 40) == done == store.publish(1, "a" * 40, n.limit(0), e, docs)


def test_put_is_whole_and_first(spark, tmp_path):
    store = files.Store(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: store.put({"i": i}, "x", "v.json"), range(8)))
    assert sum(won) == 1 and store.value("x", "v.json") == {"i": won.index(True)}
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["v.json"]


def test_pointer_by_compare_and_swap(spark, tmp_path, monkeypatch):
    store = files.Store(spark, f"file://{tmp_path}")
    monkeypatch.setattr(files.Store, "manifest", lambda self, repo, revision: {} if revision != "gone" else None)
    assert store.pointer(1) is None and store.point(1, "a", 0, fence=5) and not store.point(1, "b", 0, fence=5)
    assert store.pointer(1)["revision"] == "a" and not store.point(1, "b", 1, fence=4)  # an older worker's fence
    with pytest.raises(FileNotFoundError):
        store.point(1, "gone", 1, fence=5)
    (tmp_path / "pointers/1/000000000002.json").write_text("{")  # torn
    assert store.pointer(1)["version"] == 1 and store.point(1, "b", 1, fence=6) and store.pointer(1)["revision"] == "b"
    assert store.point(2, "z", 0, fence=1)
    assert {tuple(r) for r in store.pointers().select("repo", "version", "revision", "fence").collect()} == {(1, 2, "b", 6), (2, 1, "z", 1)}


def test_mirror_and_checkout(spark, tmp_path):
    env = {"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path), "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}
    work, mirror, url = tmp_path / "work", str(tmp_path / "mirror.git"), f"file://{tmp_path}/work"
    do = lambda *w: subprocess.run(["git", "-C", str(work), *w], check=True, env=env, capture_output=True)
    work.mkdir()
    do("init", "-q", "-b", "main")
    assert repositories.remote_head(url) is None
    (work / "a").mkdir()
    (work / "a/x.py").write_text("x = 1\n")
    (work / "link").symlink_to("a/x.py")
    do("add", "-A")
    do("commit", "-q", "-m", "one")
    one = repositories.sync(url, mirror)
    assert one == repositories.remote_head(url)
    do("checkout", "-q", "-b", "next")
    (work / "b.txt").write_text("b")
    do("add", "-A")
    do("commit", "-q", "-m", "two")
    do("branch", "-q", "-D", "main")
    two = repositories.sync(url, mirror)  # HEAD moved to another branch, the old one is gone
    assert two == repositories.remote_head(url) != one and repositories.run("-C", mirror, "for-each-ref", "--format=%(refname)").split() == ["refs/heads/next"]
    subprocess.run(["rm", "-r", f"{mirror}/objects"], check=True)
    assert repositories.sync(url, mirror) == two  # healed
    subprocess.run(["rm", "-r", mirror], check=True)
    repositories.run("clone", "-q", "--bare", "--depth", "1", url, mirror)
    assert repositories.sync(url, mirror) == two and repositories.run("-C", mirror, "rev-list", "--count", "HEAD").strip() == "2"
    repositories.checkout(mirror, two, str(tmp_path / "tree"))
    assert sorted(p for p, _ in files.entries(str(tmp_path / "tree"))) == ["a/x.py", "b.txt", "link"]
    with pytest.raises(subprocess.CalledProcessError):
        repositories.checkout(mirror, "0" * 40, str(tmp_path / "none"))
    assert not list(tmp_path.glob("none*"))
    with pytest.raises(ValueError):
        repositories.checkout(mirror, "HEAD", str(tmp_path / "none"))
    heads = repositories.remote_heads(spark.createDataFrame([("r", url), ("gone", f"file://{tmp_path}/gone")], "repo string, url string")).collect()
    assert {(r["repo"], r["head"], r["error"]) for r in heads} == {("r", two, None), ("gone", None, "CalledProcessError")}
    logs = repositories.git_logs(spark.createDataFrame([("r", mirror)], "repo string, git_dir string"), batch=1).collect()
    assert [(r["repo"], r["subject"], r["paths"]) for r in logs] == [("r", "two", ["b.txt"]), ("r", "one", ["a/x.py", "link"])]


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("def f():\n    return g()\n\n\ndef g():\n    pass\n")
    (tmp_path / "bad.go").write_bytes(b"\xff\xfe")
    (tmp_path / "big.rs").write_bytes(b"x" * ((1 << 20) + 1))
    (tmp_path / "link.py").symlink_to(tmp_path / "a/x.py")
    rows = {r["path"]: r for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/x.py", "bad.go", "big.rs", "link.py"} and [p for p, r in rows.items() if r["content"]] == ["a/x.py"]
    got = {(r["fact"], r["name"], r["owner"], r["line"], r["col"]) for r in extract.extract(files.read_tree(spark, str(tmp_path))).collect()}
    assert got == {("symbol", "f", None, 1, 1), ("call", "g", "f", 2, 12), ("symbol", "g", None, 5, 1)}


def test_symbol_ordinals(spark):
    s = spark.createDataFrame([("p", "x", 1), ("p", "x", 5), ("p", "y", 2), ("q", "x", 1)], "path string, name string, pos int")
    assert {r["id"] for r in build.symbol_ordinals(s).collect()} == {"sym:p#x", "sym:p#x~2", "sym:p#y", "sym:q#x"}


def test_search(spark):
    rows = [("r1", "file:a", "File", "ratelimit.go", "ratelimit.go", "foo rateLimit"), ("r1", "file:b", "File", "b.go", "b.go", "foo rate_limit bar"), ("r1", "file:c", "File", "c.go", "c.go", "foo rate then limit"), ("r2", "sym:x", "Symbol", "rateLimit", "x.go", "")]
    docs = spark.createDataFrame(rows, "repo string, node_id string, kind string, name string, path string, content string")
    got = search.search(docs, "rateLimit").orderBy("rank").collect()
    assert {r["node_id"] for r in got} == {"file:a", "file:b", "sym:x"} and got[0]["score"] == 1.0
    assert "<b>" in next(r["snippet"] for r in got if r["node_id"] == "file:b")
    assert {r["node_id"] for r in search.search(docs, "foo -bar").collect()} == {"file:a", "file:c"}
    assert [r["node_id"] for r in search.search(docs, "rateLimit", kinds=["Symbol"]).collect()] == ["sym:x"]
    assert search.search(docs, "foo", repos=["r2"]).count() == 0
    with pytest.raises(VerbError):
        search.search(docs, "foo", offset=990, limit=20)
    with pytest.raises(VerbError) as e:
        search.search(docs, "foo", repos=["r1", "r3"])
    assert e.value.code == "not_found"


DOC = "repo string, node_id string, kind string, name string, path string, content string"


@pytest.fixture(scope="module")
def greek(spark, tmp_path_factory):
    texts = {"a": "alpha", "b": "beta", "ab": "alpha beta", "ag": "alpha gamma", "bg": "beta gamma", "abg": "alpha beta gamma", "g": "gamma", "none": "", "gx": "gammaX ray", "nul": None}
    return postings.build(spark.createDataFrame([("r", f"file:{k}", "File", k.upper(), None, v) for k, v in texts.items()], DOC), f"file://{tmp_path_factory.mktemp('index')}")


@pytest.mark.parametrize("text,want", [
    ("(alpha OR beta) AND gamma", "ag bg abg"), ("gamma -(alpha beta)", "g gx"), ("alpha AND beta OR gamma", "ab abg ag bg g gx"), ("alpha AND beta gamma", "ab abg ag bg g gx"),
    ("+alpha -beta", "a ag"), ("alpha AND NOT (beta OR gamma)", "a"), ("content:IN [alpha ray]", "a ab ag abg gx"), ("+gamma +(alpha OR ray)", "ag abg gx"), ("* -alpha", "b bg g none gx nul"),
    ('"alpha beta"', "ab abg"), ('gamma -"beta gamma"', "ag g gx"), ("gammaX", "gx"), ("gammax", "gx"), ("name:g", "g"), ("terms:ABG", "abg"), ("kind:File AND ray", "gx"), ("node_id:file\\:ab", "ab"), ('"--" alpha', "a ab ag abg"), ('+"--" alpha', ""), ("((-alpha) beta)", "b ab bg abg"), ("nothing", ""), ("!!", ""),
])
def test_boolean_search(greek, text, want):
    got = {r["node_id"].removeprefix("file:") for r in search.bm25(greek, parse(text)).collect()}
    assert got == set(want.split())


def test_segments_that_cannot_reach_the_best_are_left_out(spark, tmp_path, monkeypatch):
    """A repository of many segments: the best by the pruned way are the best of all, and most segments aren't unpacked."""
    monkeypatch.setattr(postings, "SEGMENT", 8)
    r = random.Random(2)
    rows = [("big", f"file:{i:04}", "File", "n", "p", " ".join(r.choices(["alpha", "beta"] + ["x", "y", "z"] * 6, k=r.randrange(3, 60)))) for i in range(600)]
    rows += [("small", f"file:{i}", "File", "n", "p", "alpha " * i) for i in range(5)]
    index = postings.build(spark.createDataFrame(rows, DOC), f"file://{tmp_path}")
    for text in ("alpha", "content:alpha^3 content:beta", "(alpha beta)^2 x"):
        tree = parse(text)
        whole = {(x["repo"], x["doc"]): round(x["score"], 9) for x in postings.scores(index, tree).collect()}
        some = {(x["repo"], x["doc"]): round(x["score"], 9) for x in postings.scores(index, tree, most=10).collect()}
        assert all(whole[k] == v for k, v in some.items())
        for repo in ("big", "small"):
            best = sorted((-v, k) for k, v in whole.items() if k[0] == repo)[:10]
            assert sorted((-v, k) for k, v in some.items() if k[0] == repo)[:10] == best
    assert len([k for k in some if k[0] == "big"]) <= len([k for k in whole if k[0] == "big"])
    few = postings.scores(index, parse("content:alpha"), most=10).count()
    assert few < 0.7 * postings.scores(index, parse("content:alpha")).count()


def test_search_kinds_keep_statistics(spark):
    rows = [("r", f"file:{i}", "File", f"n{i}", f"p{i}", "alpha") for i in range(3)] + [("r", "sym:x", "Symbol", "alpha", "q", "")]
    index = search.indexed(spark.createDataFrame(rows, DOC))
    whole = {r["node_id"]: r["score"] for r in search.bm25(index, parse("alpha")).collect()}
    only = {r["doc"]: r["score"] for r in postings.scores(index, parse("alpha"), kinds=["Symbol"]).collect()}
    assert list(only.values()) == [whole["sym:x"]]


def test_fuzzy(spark):
    docs = spark.createDataFrame([("r", f"sym:f{i}.go#n", "Symbol", "n", f"f{i}.go", "") for i in range(30)] + [("r", f"sym:g{i}#m", "Symbol", "m", "g", "") for i in range(257)] + [("r", "sym:h#o", "Symbol", "o", "h", "")], "repo string, node_id string, kind string, name string, path string, content string")
    got = {r["name"]: r for r in search.fuzzy(docs, spark.createDataFrame([("n",), ("m",), ("o",), ("none",)], "name string")).collect()}
    assert (got["n"]["outcome"], got["n"]["total"], len(got["n"]["candidates"]), got["n"]["confidence"]) == ("ambiguous", 30, 25, 0.9 / 30)
    assert [got[k]["outcome"] for k in ("m", "o", "none")] == ["unaddressable", "exact", "no_such_symbol"]


def test_cap_body():
    assert build.cap_body("aé".encode(), 2) == "a" and build.cap_body(b"\xff") is None and build.cap_body(b"") == "" and build.cap_body(None) is None
    assert ids.LANGUAGES["go"] == ("go",)


@pytest.fixture
def server():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/repo":
                fresh = self.headers.get("If-None-Match") == '"1"'
                self.send_response(304 if fresh else 200)
                self.send_header("ETag", '"1"')
                self.end_headers()
                if not fresh:
                    self.wfile.write(b"head")
                return
            n = int(self.path.rpartition("=")[2])
            self.send_response(200)
            if n < 3:
                self.send_header("Link", f'</list?page={n + 1}>; rel="next", </list?page=1>; rel="first"')
            elif n == 8:
                self.send_header("Link", '</list?page=8>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps([{"full_name": f"o/{n}", "private": n == 2, **({"visibility": "internal"} if n == 3 else {})}]).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_sources(spark, server, tmp_path):
    from lattica.sources import http

    first = http.poll(f"{server}/repo", {})
    assert first.changed and first.body == b"head" and http.poll(f"{server}/repo", first.validators) == http.Poll(False, None, first.validators, True)
    with pytest.raises(VerbError):
        list(http.listing(f"{server}/list?page=8"))
    spark.dataSource.register(http.ListingSource)
    spark.dataSource.register(http.PollSource)
    got = spark.read.format("forge_listing").option("urls", f"{server}/list?page=1 {server}/list?page=9").load()
    assert {tuple(r) for r in got.collect()} == {("o/1", "public"), ("o/2", "private"), ("o/3", "internal"), ("o/9", "public")}
    q = spark.readStream.format("forge_poll").option("url", f"{server}/repo").load().writeStream.format("memory").queryName("polls").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["body"] for r in spark.table("polls").collect()] == ["head"]


def test_extraction_is_dealt_to_tasks(spark):
    one = spark.createDataFrame([(f"{i}.py", "python", "import os") for i in range(40)], "path string, language string, content string").coalesce(1)
    assert extract.extract(one).where("name = 'os'").select(F.spark_partition_id()).distinct().count() > 1

"""Cursors, the operations behind them, the queue's loop and the guards that don't need a table."""

import base64
import threading
import time

import pytest
from pyspark.sql import functions as F

from lattica.functions import cursor
from lattica.operators import graph, postings, resolve, verbs
from lattica.schema import EDGE_KINDS, VerbError
from lattica.sources import files
from lattica.streaming import stateful, worker

from .test_operators import edges, nodes

REPO = "h.example/a"


def code(f, *args, **kwargs):
    with pytest.raises(VerbError) as e:
        f(*args, **kwargs)
    return e.value.code


def test_cursor_codec():
    c = cursor.Codec(b"key", "neighbors")
    text = c.encode({"after": [1, "é"], "revision": "r"})
    assert text.startswith("v1.") and "=" not in text and c.decode(text) == {"after": [1, "é"], "revision": "r"}
    version, payload, signature = text.split(".")
    other = base64.urlsafe_b64encode(b'{"after":[2,"x"]}').decode().rstrip("=")
    for bad in ("", "v1", "v1.", f"v2.{payload}.{signature}", f"v1.{other}.{signature}", f"v1.{payload}.", f"v1.{payload}.{signature[:-2]}", f"v1.{payload}.!!", text + "x" * (1 << 20), f"v1.é.{signature}"):
        assert code(c.decode, bad) == "invalid_cursor"
    assert code(cursor.Codec(b"other", "neighbors").decode, text) == "invalid_cursor" and code(cursor.Codec(b"key", "history").decode, text) == "invalid_cursor"


def test_cursor_agreement():
    told = {"request": cursor.shape("file:r:a", "both", ["CALLS", "IMPORTS", "CALLS"], 2)}
    cursor.agree(told, cursor.shape("file:r:a", "both", ["IMPORTS", "CALLS"], 2))
    cursor.agree({"request": cursor.shape("n", kinds=EDGE_KINDS)}, cursor.shape("n"))
    for other in (cursor.shape("file:r:b", "both", ["CALLS", "IMPORTS"], 2), cursor.shape("file:r:a", "in", ["CALLS", "IMPORTS"], 2), cursor.shape("file:r:a", "both", ["CALLS"], 2), cursor.shape("file:r:a", "both", ["CALLS", "IMPORTS"], 1), cursor.shape("file:r:a", since=3)):
        assert code(cursor.agree, told, other) == "invalid_cursor"


@pytest.fixture(scope="module")
def engine(spark):
    files = [f"file:{x}" for x in "abcdefg"]
    n = nodes(spark, files).unionByName(spark.createDataFrame([(f"commit:{i}", "Commit", f"s{i}", None, 100 + i // 2) for i in range(5)], "id string, kind string, name string, path string, committed_at long"))
    e = edges(spark, [("file:a", f, "IMPORTS") for f in files[1:]] + [(f"commit:{i}", "file:a", "TOUCHES") for i in range(5)])
    catalog = verbs.Catalog()
    catalog.put(REPO, "one", graph.plain(n, e))
    return verbs.Engine(catalog, b"key")


def test_neighbors_by_cursor(spark, engine):
    seen, cursors, at = [], [], None
    while not seen or at:
        page = engine.neighbors(f"file:{REPO}:a", kinds=["IMPORTS"], limit=4, cursor=at)
        seen.append([r["id"] for r in page.rows.orderBy("rank").collect()])
        at = page.next
        cursors.append(at)
    assert seen == [[f"file:{x}" for x in "bcde"], ["file:f", "file:g"]] and cursors[1] is None
    assert [r["id"] for r in engine.neighbors(f"file:{REPO}:a", kinds=["IMPORTS"], limit=1, cursor=cursors[0]).rows.collect()] == ["file:f"]  # the size may differ
    assert code(engine.neighbors, f"file:{REPO}:a", cursor=cursors[0]) == "invalid_cursor"  # other kinds
    assert code(engine.history, f"file:{REPO}:a", cursor=cursors[0]) == "invalid_cursor"  # another operation
    one = engine.catalog.graphs[REPO, "one"]
    engine.catalog.put(REPO, "two", graph.plain(one.nodes, one.edges.where("dst <> 'file:f'")))
    again = lambda: [r["id"] for r in engine.neighbors(f"file:{REPO}:a", kinds=["IMPORTS"], limit=4, cursor=cursors[0]).rows.orderBy("rank").collect()]
    assert again() == ["file:f", "file:g"]  # of the revision of the first page
    engine.catalog.drop(REPO, "one")
    assert code(again) == "gone" and code(engine.neighbors, "file:h.example/other:a") == "not_found" and code(engine.neighbors, "nothing") == "bad_request"
    engine.catalog.put(REPO, "one", one)


def test_history_by_cursor(spark, engine):
    seen, at = [], None
    while not seen or at:
        page = engine.history(f"file:{REPO}:a", limit=2, cursor=at)
        seen.append([r["id"] for r in page.rows.orderBy(F.desc("committed_at"), "id").collect()])
        at = page.next
    assert seen == [["commit:4", "commit:2"], ["commit:3", "commit:0"], ["commit:1"]]
    assert code(engine.history, f"file:{REPO}:a", limit=0) == "bad_request"


def test_node(engine):
    rows = engine.node(f"file:{REPO}:a").collect()
    assert {(r["direction"], r["kind"], r["count"]) for r in rows} == {("out", "IMPORTS", 6), ("in", "TOUCHES", 5)} and {r["name"] for r in rows} == {"file:a"}
    assert code(engine.node, f"file:{REPO}:zz") == "not_found"


def test_heartbeat_and_drain():
    lock, queue, settled, beats = threading.Lock(), list(range(12)), [], []

    def claim():
        with lock:
            return queue.pop() if queue else None

    def run(job):
        time.sleep(0.05)
        if job == 3:
            raise ValueError("no")
        return job * 2

    def renew(job):
        beats.append(job)
        return job != 5  # another worker has it

    settle = lambda job, outcome, result: settled.append((job, outcome, result)) or True
    stop = threading.Event()

    def step():
        found = worker.work_once(claim, run, renew, settle, 0.06)
        if not found:
            stop.set()
        return found

    worker.drain(step, stop, idle=0.01, loops=3)
    assert sorted(settled) == sorted([(i, "done", 2 * i) for i in range(12) if i not in (3, 5)] + [(3, "failed", "no")]) and set(beats) == set(range(12))
    at = len(beats)
    time.sleep(0.1)
    assert len(beats) == at  # none goes on behind its job


def test_fallback_bucket():
    b = stateful.Budget(60.0, 2.0)
    assert [b.take(0.0, 1, None, False)[0] for _ in range(3)] == [True, True, False]  # two a minute of its own
    assert all(b.take(1.0, 1, None, True)[0] for _ in range(60)) and not b.take(1.0, 1, None, True)[0]
    b = stateful.Budget(60.0, 2.0)
    assert all(b.take(0.0, 1, None, True)[0] for _ in range(5))
    assert not b.take(0.0, 1, None, False)[0]  # what the fleet granted was spent here too
    assert not b.take(100.0, 1, 30.0, False)[0]  # a cooldown that is reported meanwhile
    assert b.take(120.0, 1, None, True) == (False, pytest.approx(11.0)) and b.take(131.0, 1, None, True)[0]


def test_auth_failures(spark):
    asked = [(0, "bad", False), (1, "bad", False), (2, "good", True), (3, "worse", False), (4, "new", True), (5, "good", True), (61, "bad", False), (62, "new", True)]
    df = spark.createDataFrame([("s", float(t), i, k, v) for i, (t, k, v) in enumerate(asked)], "service string, ts double, id long, token string, valid boolean")
    got = [(r["outcome"], r["retry_after"]) for r in stateful.auth_failures(df, most=2).orderBy("id").collect()]
    assert got == [("rejected", 0.0), ("cached", 59.0), ("accepted", 0.0), ("rejected", 0.0), ("limited", 56.0), ("accepted", 0.0), ("rejected", 0.0), ("limited", 1.0)]


def test_deep_closure(spark):
    n = 70
    direct = spark.createDataFrame([(i, f"m{i}") for i in range(n)], "iface_id long, name string")
    embeds = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "iface_id long, embedded long")
    none = spark.createDataFrame([], "iface_id long")
    assert resolve.interface_closure(direct, embeds, none).where("iface_id = 0").count() == n
    with pytest.raises(RuntimeError):
        resolve.interface_closure(direct, embeds, none, rounds=3)


DOC = "repo string, node_id string, kind string, name string, path string, content string"


def test_search_by_cursor_over_pinned_revisions(spark, tmp_path):
    rows = [(f"h.example/{r}", f"file:{i}", "File", f"n{i}", f"p{i}", "alpha beta" if i % 3 else "alpha") for r in "ab" for i in range(7)]
    both = postings.build(spark.createDataFrame(rows, DOC), f"file://{tmp_path}/both")
    other = postings.build(spark.createDataFrame([("h.example/c", "file:x", "File", "n", "p", "alpha"), ("h.example/c", "sym:y", "Symbol", "alpha", "p", None)], DOC), f"file://{tmp_path}/other")
    catalog = verbs.Catalog()
    for r in "ab":
        catalog.put(f"h.example/{r}", "1", None, both)
    catalog.put("h.example/c", "1", None, other)
    e, seen, at = verbs.Engine(catalog, b"key"), [], None
    whole = [(r["repo"], r["node_id"], r["score"]) for r in e.search("alpha", limit=100).rows.orderBy("rank").collect()]
    assert len(whole) == 16 and whole == sorted(whole, key=lambda x: (-x[2], x[0], x[1])) and len({x[2] for x in whole}) < 8  # ties
    while not seen or at:
        page = e.search("alpha", limit=5, cursor=at)
        seen += [(r["repo"], r["node_id"], r["score"]) for r in page.rows.orderBy("rank").collect()]
        at = page.next
        catalog.put("h.example/a", "2", None, other)  # published anew: pages go on with what the first read
        e.found.clear()
    assert seen == whole
    first = e.search("alpha", repos=["h.example/b", "h.example/c"], limit=2).next
    assert code(e.search, "beta", repos=["h.example/b", "h.example/c"], cursor=first) == "invalid_cursor" == code(e.search, "alpha", cursor=first)
    assert e.search("alpha", repos=["h.example/c", "h.example/b"], cursor=first).rows.count() == 7
    catalog.drop("h.example/c", "1")
    assert code(e.search, "alpha", repos=["h.example/b", "h.example/c"], cursor=first) == "gone"
    assert code(e.search, "alpha", repos=["h.example/none"]) == "not_found" and code(e.search, "alpha", limit=0) == "bad_request" and code(e.search, "title:alpha") == "bad_request"
    assert [r["node_id"] for r in e.search("alpha", kinds=["Symbol"], repos=["h.example/b"]).rows.collect()] == []


def test_catalog_of_published_artifacts(spark, tmp_path):
    store = files.Store(spark, f"file://{tmp_path}")
    n, e = nodes(spark, ["file:a", "file:b"]).withColumn("repo", F.lit("x")), edges(spark, [("file:a", "file:b", "IMPORTS")])
    docs = spark.createDataFrame([("x", "file:a", "File", "a", "a", "hello world"), ("x", "file:b", "File", "b", "b", "world")], DOC)
    store.publish(7, "c" * 40, n, e, docs)
    assert store.point(7, store.revision("c" * 40, "syntactic"), 0, fence=1)
    engine = verbs.Engine(verbs.Catalog.of(store, {7: REPO, 8: "h.example/unpublished"}), b"key")
    assert [(r["repo"], r["node_id"]) for r in engine.search("hello").rows.collect()] == [(REPO, "file:a")]
    assert [r["id"] for r in engine.neighbors(f"file:{REPO}:a").rows.collect()] == ["file:b"]
    assert code(engine.search, "hello", repos=["h.example/unpublished"]) == "not_found"

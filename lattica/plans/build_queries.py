"""Queries of the build, extraction and stateful operators on the driver's tables, with their oracles."""

from __future__ import annotations

import os
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import ids
from lattica.functions.query import FIELDS
from lattica.operators import build as B
from lattica.operators import dataflow as DF
from lattica.plans import fixtures as X
from lattica.plans import oracle_views as V
from lattica.plans import text_queries as T0
from lattica.plans.registry import query
from lattica.operators import search as S
from lattica.sources import extract as E
from lattica.sources import files as FS
from lattica.sources import git as GIT
from lattica.sources import http as H
from lattica.sources.scratch import scratch, settle
from lattica.streaming import leases as LS
from lattica.streaming import stateful as T


@query("x_mint_ids", V.graph("SELECT id FROM nodes"))
def x_mint_ids(spark, d):
    return X.nodes(spark, d).select("id")


@query("x_valid_sha", "SELECT o_orderkey, o_orderkey % 4 < 2 AS ok FROM orders")
def x_valid_sha(spark, d):
    sha, n = F.sha1(F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 4
    text = F.when(n == 0, sha).when(n == 1, F.sha2(F.col("o_orderkey").cast("string"), 256)).when(n == 2, F.concat(F.lit("G"), F.substring(sha, 2, 39))).otherwise(F.substring(sha, 1, 39))
    return X.table(spark, d, "orders").select("o_orderkey", ids.valid_sha(text).alias("ok"))


@query("x_path_parts", f"WITH {V.PARTS} SELECT path, p_partkey || '.go' AS name, dir FROM p")
def x_path_parts(spark, d):
    return X.parts(spark, d).select("path", ids.file_name(F.col("path")).alias("name"), ids.file_dir(F.col("path")).alias("dir"))


@query("x_gomod", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN 'corp.example/' || s_nationkey END AS module FROM supplier")
def x_gomod(spark, d):
    n, name = F.col("s_suppkey") % 3, F.concat(F.lit("corp.example/"), F.col("s_nationkey").cast("string"))
    body = F.when(n == 0, F.concat(F.lit("// a module\nmodule "), name, F.lit(" // here\n\ngo 1.22\n"))).when(n == 1, F.concat(F.lit('module "'), name, F.lit('"\n'))).otherwise("go 1.22\n")
    return X.table(spark, d, "supplier").select("s_suppkey", ids.go_module(body).alias("module"))


@query("x_import_filter", "SELECT s_suppkey, s_suppkey % 6 IN (0, 2, 4) AS internal FROM supplier")
def x_import_filter(spark, d):
    n = F.col("s_suppkey") % 6
    lang = F.when(n < 2, "rust").when(n < 4, "python").otherwise("ecmascript")
    path = F.element_at(F.array(*map(F.lit, ("crate::a", "serde::de", ".mod", "os.path", "../x", "react"))), (n + 1).cast("int"))
    return X.table(spark, d, "supplier").select("s_suppkey", ids.relative_import(lang, path).alias("internal"))


@query("x_language", "SELECT p_partkey, (['go', 'typescript', 'tsx', 'javascript', 'python', 'rust', 'java', NULL])[1 + p_partkey % 8] AS language FROM part")
def x_language(spark, d):
    ends = F.array(*map(F.lit, (".go", ".ts", ".tsx", ".mjs", ".py", ".rs", ".java", ".txt")))
    return X.table(spark, d, "part").select("p_partkey", ids.language(F.concat(F.lit("a/b"), F.element_at(ends, (F.col("p_partkey") % 8 + 1).cast("int")))).alias("language"))


@query("x_manifest_agree", V.control("SELECT shard_id, suffix(revision, '-v7') AS agrees FROM shards"))
def x_manifest_agree(spark, d):
    made = F.concat_ws("-", "commit_sha", F.lit("syntactic"), F.lit("v7"))
    return X.shards(spark, d).select("shard_id", (made == F.col("revision")).alias("agrees"))


@query("x_cap_body", "SELECT doc_id, text[:200] AS body FROM (SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE (SELECT max(text[:k]) FROM range(0, 201) r(k) WHERE strlen(text[:k]) <= 200) END AS text FROM documents)")
def x_cap_body(spark, d):
    body = F.pandas_udf(lambda s: s.map(lambda b: B.cap_body(b, 200)), "string")
    return X.table(spark, d, "documents").select("doc_id", body(F.col("text").cast("binary")).alias("body"))


@query("x_file_degradation", "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN md5(text) END AS digest FROM documents")
def x_file_degradation(spark, d):
    files = X.table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("length"), F.col("text").alias("content"))
    return B.degrade(files, 1000).select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"))


def commits(spark, d):
    o, c = X.table(spark, d, "orders"), X.table(spark, d, "customer")
    touched = X.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p/"), F.col("l_partkey").cast("string"))).alias("paths"))
    email = F.when(F.col("c_custkey") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" c"), (F.col("c_custkey") % 50).cast("string"), F.lit("@example.com ")))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(touched, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.sha1(F.col("o_orderkey").cast("string")).alias("sha"), X.seconds("o_orderdate").alias("ct"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("author"), email.alias("email"), F.col("o_orderpriority").alias("subject"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


COMMITS = """c AS (SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS ct, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS author, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'c' || c_custkey % 50 || '@example.com' END AS email, o_orderpriority AS subject FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("x_contributors", f"WITH {COMMITS} SELECT 'contributor:' || email AS id, author AS name FROM c WHERE email <> '' QUALIFY row_number() OVER (PARTITION BY email ORDER BY ct DESC, sha) = 1")
def x_contributors(spark, d):
    return B.history_graph(commits(spark, d))[0].where("kind = 'Contributor'").select("id", "name")


@query("x_history_graph", f"WITH {COMMITS} SELECT 'contributor:' || email AS src, 'commit:' || sha AS dst, 'AUTHORED' AS kind FROM c WHERE email <> '' UNION ALL SELECT DISTINCT 'commit:' || sha, 'file:p/' || l_partkey, 'TOUCHES' FROM c JOIN lineitem ON l_orderkey = o_orderkey")
def x_history_graph(spark, d):
    return B.history_graph(commits(spark, d))[1].select("src", "dst", "kind")


@query("x_merge_history", V.graph("SELECT src, dst, kind FROM edges WHERE kind <> 'TOUCHES' UNION ALL SELECT src, dst, kind FROM edges WHERE kind = 'TOUCHES' AND regexp_extract(dst, '/(\\d+)\\.go', 1)::BIGINT % 2 = 0"))
def x_merge_history(spark, d):
    e = X.edges(spark, d).select("src", "dst", "kind")
    files = X.parts(spark, d).where("p_partkey % 2 = 0").select(F.col("file_id").alias("id"))
    history = e.where("kind IN ('TOUCHES', 'AUTHORED')")
    return B.merge_history(e.where("kind NOT IN ('TOUCHES', 'AUTHORED')"), history, files)


def raw_edges(spark, d):
    """IMPORTS as they come, a line each, so that they repeat; every 50th order's with another confidence."""
    li = X.table(spark, d, "lineitem").join(X.parts(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    odd = F.when(F.col("l_orderkey") % 50 == 0, 0.5).otherwise(1.0)
    return li.select(F.col("file_id").alias("src"), F.concat(F.lit("pkg:suppliers/"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("IMPORTS").alias("kind"), F.lit("syntactic").alias("provenance"), odd.alias("confidence"), F.lit(None).cast("string").alias("location"), F.col("l_orderkey").alias("edge_seq"))


RAW = V.PARTS + ", raw AS (SELECT file_id AS src, 'pkg:suppliers/' || l_suppkey AS dst, CASE WHEN l_orderkey % 50 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, l_orderkey FROM lineitem JOIN p ON l_partkey = p_partkey)"


@query("x_dedup_edges", f"WITH {RAW} SELECT src, dst, confidence, min(l_orderkey) AS edge_seq FROM raw GROUP BY src, dst, confidence")
def x_dedup_edges(spark, d):
    return B.dedup_edges(raw_edges(spark, d)).select("src", "dst", "confidence", "edge_seq")


@query("x_edge_conflicts", f"WITH {RAW} SELECT src, dst, CAST(count(DISTINCT confidence) AS BIGINT) AS n FROM raw GROUP BY src, dst HAVING count(DISTINCT confidence) > 1")
def x_edge_conflicts(spark, d):
    return B.edge_conflicts(raw_edges(spark, d)).select("src", "dst", "n")


@query("x_packages", "SELECT DISTINCT 'pkg:suppliers/' || l_suppkey AS id, 'suppliers/' || l_suppkey AS name FROM lineitem")
def x_packages(spark, d):
    paths = X.table(spark, d, "lineitem").select(F.concat(F.lit("suppliers/"), F.col("l_suppkey").cast("string")).alias("import_path"))
    return B.packages(paths).select("id", "name")


def brand_symbols(spark, d):
    """Symbols of a file per brand, whose names repeat."""
    return X.parts(spark, d).select(F.concat("dir", F.lit(".go")).alias("path"), "name", F.col("p_partkey").alias("pos"))


ORDINALS = f"WITH {V.PARTS} SELECT dir || '.go' AS path, name, 'sym:' || dir || '.go#' || name || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY p_partkey) AS n FROM p)"


@query("x_symbol_ordinals", ORDINALS)
def x_symbol_ordinals(spark, d):
    return B.symbol_ordinals(brand_symbols(spark, d)).select("path", "name", "id")


@query("x_defines", f"SELECT 'file:' || path AS src, id AS dst FROM ({ORDINALS})")
def x_defines(spark, d):
    return B.defines(B.symbol_ordinals(brand_symbols(spark, d))).select("src", "dst")


@query("x_extends", "SELECT s_suppkey AS src, s_nationkey AS dst FROM supplier WHERE s_suppkey % 2 = 1 OR s_nationkey % 2 = 0")
def x_extends(spark, d):
    s = X.table(spark, d, "supplier")
    faces = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id")).unionByName(spark.range(0, 26, 2)).distinct()
    return B.extends(s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")), faces)


PHASES = ("IMPORTS", "CALLS", "DEFINES")


@query("x_emit_edges", V.graph("SELECT src, dst, location, concat_ws(chr(1), lpad((list_position(['IMPORTS', 'CALLS', 'DEFINES'], kind) - 1)::VARCHAR, 3, '0'), src, '0000000000', dst) AS edge_seq FROM edges WHERE kind IN ('IMPORTS', 'CALLS', 'DEFINES')"))
def x_emit_edges(spark, d):
    made, calls = X.kinds(spark, d), X.references(spark, d)
    phases = {k: made[k].select(F.col("src").alias("path"), F.lit(0).alias("site"), "src", "dst", "location") for k in PHASES if k != "CALLS"}
    phases["CALLS"] = calls._replace(refs=calls.refs.withColumns({"path": F.col("caller_id"), "site": F.lit(0)}))
    return B.emit(*[phases[k] for k in PHASES]).select("src", "dst", "location", "edge_seq")


@query("x_counts", V.graph("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"))
def x_counts(spark, d):
    return B.counts(X.nodes(spark, d), X.edges(spark, d, False), X.references(spark, d))


def sources(spark, d, language: str, template: str):
    """A source file per part in a language; {n} is the part's number, {name} its name."""
    body = F.lit(template)
    for mark, value in (("{n}", F.col("p_partkey").cast("string")), ("{name}", F.col("name"))):
        body = F.replace(body, F.lit(mark), value)
    return X.parts(spark, d).select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string")).alias("path"), F.lit(language).alias("language"), body.alias("content"), "p_partkey", "name")


SAMPLES = {
    "go": ('package p\n\nimport "corp.example/lib"\n\ntype T{n} struct {\n\tBase\n}\n\n// Go {name}(\nfunc (t *T{n}) {name}() int {\n\treturn helper("f(x)") + lib.Do()\n}\n\nfunc helper(s string) int { return 1 }\n',
           [("symbol", "'T' || p_partkey"), ("embed", "'Base'"), ("symbol", "'T' || p_partkey || '.' || name"), ("method", "name"), ("symbol", "'helper'"), ("call", "'helper'"), ("call", "'Do'"), ("import", "'corp.example/lib'")]),
    "python": ('import os\nfrom .x import y\n\nLIMIT = {n}\n\n\nclass C:\n    def {name}(self):\n        return self.other() + helper(1)\n\n\ndef helper(a):\n    return os.getpid()\n',
               [("import", "'os'"), ("symbol", "'LIMIT'"), ("symbol", "'C'"), ("symbol", "'C.' || name"), ("call", "'other'"), ("call", "'helper'"), ("symbol", "'helper'")]),
    "rust": ('use std::fs;\nuse crate::x;\n\nconst N: u32 = {n};\n\nstruct S;\n\nimpl S {\n    fn {name}(&self) -> u32 { helper(1) }\n}\n\nfn helper(a: u32) -> u32 { a }\n',
             [("import", "'std'"), ("symbol", "'N'"), ("symbol", "'S'"), ("symbol", "'S.' || name"), ("call", "'helper'"), ("symbol", "'helper'")]),
    "java": ('package p;\n\nimport java.util.List;\n\npublic class C{n} {\n    public int {name}(int a) {\n        return helper(a);\n    }\n\n    int helper(int a) {\n        return a;\n    }\n}\n',
             [("import", "'java.util.List'"), ("symbol", "'C' || p_partkey"), ("symbol", "'C' || p_partkey || '.' || name"), ("call", "'helper'"), ("symbol", "'C' || p_partkey || '.helper'")]),
    "typescript": ("import x from 'react';\nimport y from './y';\n\nconst N = {n};\n\nclass C {\n  {name}(a) {\n    return this.other(a) + helper(1);\n  }\n}\n\nfunction helper(a) { return a; }\n",
                   [("import", "'react'"), ("symbol", "'N'"), ("symbol", "'C'"), ("symbol", "'C.' || name"), ("call", "'other'"), ("call", "'helper'"), ("symbol", "'helper'")]),
}

for _lang, (_text, _facts) in SAMPLES.items():
    _sql = f"WITH {V.PARTS} " + " UNION ALL ".join(f"SELECT 'src/' || p_partkey AS path, '{f}' AS fact, {e} AS name FROM p" for f, e in _facts)
    query("x_extract_ecma" if _lang == "typescript" else f"x_extract_{_lang}", _sql)(lambda spark, d, lang=_lang, text=_text: E.extract(sources(spark, d, lang, text)).select("path", "fact", "name"))


def second(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


BUCKET = """WITH RECURSIVE r AS MATERIALIZED (SELECT event_type AS forge, epoch_us(ts) / 1e6 AS ts, event_id AS id, CAST(props->>'$.k' AS DOUBLE) % 5 + 1 AS need, event_id % 97 = 0 AS cools, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT event_type AS forge, 0.0::DOUBLE AS ts, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS n, 60.0::DOUBLE AS tokens, NULL::DOUBLE AS seen_at, 0.0::DOUBLE AS cooldown, false AS granted, 0.0::DOUBLE AS retry_after FROM events UNION ALL
SELECT forge, ts, id, n, CASE WHEN granted THEN have - need ELSE have END, ts, cooldown, granted, CASE WHEN granted THEN 0.0 ELSE wait + greatest(need - have, 0.0) * 60.0 / 60.0 END FROM (
SELECT *, wait = 0 AND have >= need AS granted FROM (
SELECT *, least(least(tokens + greatest(0.0, ts - coalesce(seen_at, ts)) * 60.0 / 60.0, 60.0), 60.0) AS have, greatest(0.0, cooldown - ts) AS wait FROM (
SELECT r.forge, r.ts, r.id, r.n, r.need, CASE WHEN cools THEN 0.0 ELSE f.tokens END AS tokens, CASE WHEN cools THEN greatest(r.ts, f.cooldown) ELSE f.seen_at END AS seen_at, CASE WHEN cools THEN greatest(f.cooldown, r.ts + 30.0) ELSE f.cooldown END AS cooldown FROM f JOIN r ON r.forge = f.forge AND r.n = f.n + 1))))
SELECT forge, ts, id, granted, retry_after FROM f WHERE n > 0"""


def bucket_requests(spark, d):
    e = X.table(spark, d, "events")
    need = (F.get_json_object("props", "$.k").cast("double") % 5 + 1).alias("need")
    return e.select(F.col("event_type").alias("forge"), second("ts").alias("ts"), F.col("event_id").alias("id"), need, F.when(F.col("event_id") % 97 == 0, 30.0).alias("cool"))


@query("s_token_bucket", BUCKET)
def s_token_bucket(spark, d):
    return T.token_bucket(bucket_requests(spark, d), 60.0)


@query("s_fallback_bucket")
def s_fallback_bucket(spark, d):
    return T.token_bucket(bucket_requests(spark, d).withColumn("reached", F.floor(F.col("id") / 50) % 3 != 1), 60.0)


@query("s_auth_failures")
def s_auth_failures(spark, d):
    e = X.table(spark, d, "events")
    return T.auth_failures(e.select(F.col("event_type").alias("service"), second("ts").alias("ts"), F.col("event_id").alias("id"), F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("token"), (F.col("user_id") % 4 == 0).alias("valid")), 5, 4 * 3600.0)


@query("s_sliding_limiter", """WITH RECURSIVE r AS MATERIALIZED (SELECT user_id AS credential, epoch_us(ts) / 1e6 AS ts, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT user_id AS credential, 0.0::DOUBLE AS ts, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS n, []::DOUBLE[] AS seen, false AS admitted, 0.0::DOUBLE AS retry_after FROM events UNION ALL
SELECT credential, ts, id, n, CASE WHEN len(seen) < 3 THEN list_append(seen, ts) ELSE seen END, len(seen) < 3, CASE WHEN len(seen) < 3 THEN 0.0 ELSE 21600.0 - (ts - seen[1]) END FROM (
SELECT r.credential, r.ts, r.id, r.n, list_filter(f.seen, lambda x: x > r.ts - 21600.0) AS seen FROM f JOIN r ON r.credential = f.credential AND r.n = f.n + 1)) SELECT credential, ts, id, admitted, retry_after FROM f WHERE n > 0""")
def s_sliding_limiter(spark, d):
    e = X.table(spark, d, "events")
    return T.sliding_limiter(e.select(F.col("user_id").alias("credential"), second("ts").alias("ts"), F.col("event_id").alias("id")), 3, 6 * 3600.0)


@query("s_pointer_swap", """WITH RECURSIVE r AS (SELECT o_custkey AS repo_id, epoch(o_orderdate)::DOUBLE AS ts, o_orderkey AS id, sha1(CAST(o_orderkey AS VARCHAR)) AS c, CASE WHEN o_orderkey % 2 = 0 THEN sha1(CAST(o_orderkey AS VARCHAR)) ELSE sha1('none') END AS synced, o_orderkey % 3 = 0 AS late, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT repo_id, ts, id, n, true AS swapped, c AS pointer FROM r WHERE n = 1 UNION ALL
SELECT r.repo_id, r.ts, r.id, r.n, NOT late OR c = synced OR f.pointer <> synced, CASE WHEN NOT late OR c = synced OR f.pointer <> synced THEN c ELSE f.pointer END FROM f JOIN r ON r.repo_id = f.repo_id AND r.n = f.n + 1) SELECT repo_id, ts, id, swapped, pointer FROM f""")
def s_pointer_swap(spark, d):
    o, sha = X.table(spark, d, "orders"), F.sha1(F.col("o_orderkey").cast("string"))
    synced = F.when(F.col("o_orderkey") % 2 == 0, sha).otherwise(F.sha1(F.lit("none")))
    return T.pointer_swap(o.select(F.col("o_custkey").alias("repo_id"), X.seconds("o_orderdate").cast("double").alias("ts"), F.col("o_orderkey").alias("id"), sha.alias("commit_sha"), synced.alias("synced"), (F.col("o_orderkey") % 3 == 0).alias("superseded")))


@query("s_poll_reconcile", """WITH RECURSIVE r AS (SELECT user_id AS repo_id, epoch(ts) AS ts, event_id AS id, event_type AS head, event_id % 3 <> 0 AS included, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT repo_id, ts, id, n, true AS moved, CASE WHEN included THEN 'fetch' ELSE 'pending' END AS action, CASE WHEN included THEN head END AS used FROM r WHERE n = 1 UNION ALL
SELECT r.repo_id, r.ts, r.id, r.n, r.head IS DISTINCT FROM f.used, CASE WHEN r.head IS NOT DISTINCT FROM f.used THEN 'none' WHEN included THEN 'fetch' ELSE 'pending' END, CASE WHEN included THEN r.head ELSE f.used END FROM f JOIN r ON r.repo_id = f.repo_id AND r.n = f.n + 1) SELECT repo_id, id, moved, action FROM f""")
def s_poll_reconcile(spark, d):
    e = X.table(spark, d, "events")
    return T.poll_reconcile(e.select(F.col("user_id").alias("repo_id"), second("ts").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("head"), (F.col("event_id") % 3 != 0).alias("included"))).select("repo_id", "id", "moved", "action")


@query("s_complete_fetch", V.control("SELECT repo_id FROM repos WHERE repo_id % 2 = 0 AND repo_id % 3 <> 1 AND repo_id NOT IN (SELECT repo_id FROM jobs WHERE kind = 'index' AND state <> 'done')"))
def s_complete_fetch(spark, d):
    r = X.repos(spark, d).withColumn("state", F.when(F.col("repo_id") % 3 == 1, "excluded").otherwise("included"))
    _, wanted = T.complete_fetch(r.where("repo_id % 2 = 0").select("repo_id", F.lit("x").alias("commit_sha")), r, X.jobs(spark, d))
    return wanted.select("repo_id")


@query("x_parse_history", "SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS ct, o_orderpriority AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS n_paths FROM orders WHERE o_orderkey % 10 <> 7")
def x_parse_history(spark, d):
    nul, key = F.lit("\0"), F.col("o_orderkey").cast("string")
    sha = F.when(F.col("o_orderkey") % 10 == 7, "no sha").otherwise(F.sha1(key))
    paths = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("\na/"), key, nul, F.lit("b"), nul))
    log = F.concat(sha, nul, X.seconds("o_orderdate").cast("string"), nul, F.lit("A"), nul, F.lit("a@x"), nul, F.col("o_orderpriority"), nul, nul, paths)
    parse = F.pandas_udf(lambda s: s.map(lambda t: [{"sha": r[0], "ct": r[1], "subject": r[4], "n_paths": len(r[5])} for r in B.parse_history(t)]), "array<struct<sha:string,ct:long,subject:string,n_paths:int>>")
    return X.table(spark, d, "orders").select(F.explode(parse(log)).alias("r")).select("r.*")


@query("x_write_graph", V.graph("SELECT kind, CAST(count(*) AS BIGINT) AS n, count(DISTINCT src) AS n_src FROM edges GROUP BY kind"))
def x_write_graph(spark, d):
    return X.written(spark, d).degrees.groupBy("kind").agg(F.sum("outs").alias("n"), F.count_if(F.col("outs") > 0).alias("n_src"))


@query("x_write_fts", f"""WITH {T0.DOCS} f(field) AS (VALUES ('name'), ('path'), ('content'), ('name_whole'), ('path_whole'), ('content_whole')),
t AS (SELECT field, node_id, unnest({T0.SPLIT}) AS tok FROM docs, f) SELECT field, tok, CAST(count(*) AS BIGINT) AS n, count(DISTINCT node_id) AS df FROM t GROUP BY ALL""")
def x_write_fts(spark, d):
    docs = F.explode(F.arrays_zip("docs.tf", "docs.doc")).alias("x")
    rows = X.index(spark, d).blocks.where(F.col("field").isin(list(FIELDS))).select("field", F.col("token").alias("tok"), docs)
    return rows.groupBy("field", "tok").agg(F.sum("x.tf").alias("n"), F.count_distinct("x.doc").alias("df"))


def published(spark, d):
    store = FS.Store(spark, scratch(spark, "store"))
    nodes = X.nodes(spark, d).withColumn("repo", F.lit("r"))
    docs = S.search_docs(nodes, nodes.where("kind = 'File'").select(F.col("id").alias("node_id"), F.col("name").alias("content")))
    return store, store.publish(1, "a" * 40, nodes, X.edges(spark, d, False), docs, calls=X.references(spark, d))


@query("x_publish", V.graph("SELECT 7 AS schema_version, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 5 AS segments"))
def x_publish(spark, d):
    _, m = published(spark, d)
    return spark.createDataFrame([(m["schema_version"], m["counts"]["nodes"], m["counts"]["edges"], len(m["segments"]))], "schema_version int, nodes long, edges long, segments int")


@query("x_published_probe", "SELECT * FROM (VALUES ('whole', true), ('other', false), ('gone', false)) t(state, published)")
def x_published_probe(spark, d):
    store, _ = published(spark, d)
    rows = [("whole", store.published(1, "a" * 40) is not None), ("other", store.published(1, "b" * 40) is not None)]
    store.delete(1, store.revision("a" * 40, "syntactic"))
    return spark.createDataFrame([*rows, ("gone", store.published(1, "a" * 40) is not None)], "state string, published boolean")


def local(spark, what: str) -> str:
    """A new local path in the shared folder, for trees and repositories, which git and the file system have to see."""
    path = scratch(spark, what)
    if "://" in path and not path.startswith("file://"):
        raise RuntimeError("trees and repositories need a shared folder that is mounted")
    return path.removeprefix("file://")


@query("x_scan_tree", "SELECT CAST(s_nationkey AS VARCHAR) || '/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.go' END AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'python' ELSE 'go' END AS language, CAST(length(s_name) AS BIGINT) AS length, s_name AS content FROM supplier")
def x_scan_tree(spark, d):
    root = local(spark, "tree")

    def write(frames):
        for frame in frames:
            for nation, key, name in zip(frame["s_nationkey"], frame["s_suppkey"], frame["s_name"]):
                os.makedirs(f"{root}/{nation}", exist_ok=True)
                with open(f"{root}/{nation}/{key}.{'go' if key % 2 else 'py'}", "w") as f:
                    f.write(name)
            yield frame[["s_suppkey"]]

    X.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name").mapInPandas(write, "s_suppkey long").count()
    return FS.read_tree(spark, root)


def repository(spark, d, what: str, rows) -> str:
    """A repository with a commit a row: seconds, author, subject, path."""
    at, lines = local(spark, what), []
    os.makedirs(at)
    GIT.run("init", "-q", "--bare", "-b", "main", at)
    for ts, author, subject, path in rows:
        lines.append(f"commit refs/heads/main\nauthor {author} <{author.lower().replace('#', '.')}@example.com> {ts} +0000\ncommitter c <c@example.com> {ts} +0000\ndata {len(subject)}\n{subject}\nM 100644 inline {path}\ndata {len(path)}\n{path}\n")
    subprocess.run(["git", "-C", at, "fast-import", "--quiet"], input="".join(lines).encode(), check=True, capture_output=True)
    return at


def supplier_repository(spark, d) -> str:
    rows = X.table(spark, d, "supplier").orderBy("s_suppkey").toLocalIterator()
    return repository(spark, d, "repository", ((1_000_000_000 + r["s_suppkey"], r["s_name"], f"add {r['s_suppkey']}", f"{r['s_nationkey']}/{r['s_suppkey']}.txt") for r in rows))


@query("x_git_log_source", "SELECT 1000000000 + s_suppkey AS ct, s_name AS author, 'add ' || s_suppkey AS subject, s_nationkey || '/' || s_suppkey || '.txt' AS path FROM supplier")
def x_git_log_source(spark, d):
    return GIT.git_log(spark, supplier_repository(spark, d)).select("ct", "author", "subject", F.array_join("paths", " ").alias("path"))


@query("x_mirror_checkout", "SELECT s_nationkey || '/' || s_suppkey || '.txt' AS path, s_nationkey || '/' || s_suppkey || '.txt' AS content FROM supplier")
def x_mirror_checkout(spark, d):
    mirror, tree = local(spark, "mirror"), local(spark, "checkout")
    os.makedirs(os.path.dirname(mirror), exist_ok=True)
    head = GIT.sync(f"file://{supplier_repository(spark, d)}", mirror)
    GIT.checkout(mirror, head, tree)
    return FS.read_tree(spark, tree).select("path", "content")


@query("s_poll_head", "SELECT r_name AS repo, r_regionkey % 2 = 0 AS found, CASE WHEN r_regionkey % 2 = 1 THEN 'CalledProcessError' END AS error FROM region")
def s_poll_head(spark, d):
    url = lambda r: f"file://{repository(spark, d, 'head', [(1_000_000_000, 'A', r['r_name'], 'f')])}" if r["r_regionkey"] % 2 == 0 else "file:///nowhere/at/all"
    made = [(r["r_name"], url(r)) for r in X.table(spark, d, "region").toLocalIterator()]
    heads = GIT.remote_heads(spark.createDataFrame(made, "repo string, url string"))
    return heads.select("repo", F.coalesce(ids.valid_sha(F.col("head")), F.lit(False)).alias("found"), "error")


class _Pages(BaseHTTPRequestHandler):
    """Answers /<name> with its name, and with 304 to who has it already."""

    def do_GET(self) -> None:  # noqa: N802  the interface's name
        body = self.path[1:].encode()
        tag = f'"{len(body)}-{body.decode()}"'
        have = self.headers.get("If-None-Match") == tag
        self.send_response(304 if have else 200)
        self.send_header("ETag", tag)
        self.send_header("Content-Length", "0" if have else str(len(body)))
        self.end_headers()
        if not have:
            self.wfile.write(body)

    def log_message(self, *_: object) -> None:
        pass


@query("s_poll_http", "SELECT n_nationkey, true AS first, 'n' || n_nationkey AS body, false AS second, true AS free FROM nation")
def s_poll_http(spark, d):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(frames):
        for frame in frames:
            rows = []
            for key in frame["n_nationkey"]:
                one = H.poll(f"{base}/n{key}", {})
                two = H.poll(f"{base}/n{key}", one.validators)
                rows.append((key, one.changed, one.body.decode(), two.changed, two.free))
            yield pd.DataFrame(rows, columns=["n_nationkey", "first", "body", "second", "free"])

    found = X.table(spark, d, "nation").select("n_nationkey").mapInPandas(ask, "n_nationkey int, first boolean, body string, second boolean, free boolean")
    out = settle(found, "polls")
    server.shutdown()
    return out


def facts(spark, d):
    """Parts as functions of four repositories, several in a file; customers as types with their orders' keys as methods; suppliers as interfaces
    that embed the fourth before them; an order's next part is called by the one before, if of its repository."""
    p, c, s = (X.table(spark, d, t) for t in ("part", "customer", "supplier"))
    repo = lambda key: F.concat(F.lit("r"), (F.col(key) % 4).cast("string")).alias("repo")
    at = lambda folder, key, many: F.concat(F.lit(folder), F.lit("/"), F.floor(F.col(key) / many).cast("string"), F.lit(".go")).alias("path")
    part_at = F.concat(F.lit("parts/"), (F.col("p_size") % 5).cast("string"), F.lit("/"), F.floor(F.col("p_partkey") / 40).cast("string"), F.lit(".go")).alias("path")
    named = p.select("p_partkey", repo("p_partkey"), part_at, X.symbol_name().alias("name"), F.col("p_partkey").alias("pos"))
    symbols = (
        named.select("repo", "path", "name", "pos", F.lit("function").alias("form"))
        .unionByName(c.select(repo("c_custkey"), at("types", "c_custkey", 100), F.concat(F.lit("T"), (F.col("c_custkey") % 500).cast("string")).alias("name"), F.col("c_custkey").alias("pos"), F.lit("type").alias("form")))
        .unionByName(s.select(repo("s_suppkey"), at("faces", "s_suppkey", 20), F.concat(F.lit("I"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("pos"), F.lit("interface").alias("form")))
    )
    lines = X.table(spark, d, "lineitem")
    imports = lines.select("l_partkey", "l_suppkey").distinct().join(named, F.col("l_partkey") == F.col("p_partkey")).groupBy("repo", "path", F.concat(F.lit("suppliers/"), F.col("l_suppkey").cast("string")).alias("import_path")).agg(F.min("p_partkey").alias("site"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    called = lines.join(named, F.col("l_partkey") == F.col("p_partkey")).select("repo", "path", F.col("pos").alias("caller_pos"), F.lead("name").over(order).alias("callee"), (F.col("l_orderkey") * 100 + F.row_number().over(order)).alias("site"))
    own = X.table(spark, d, "orders").select(repo("o_custkey"), at("types", "o_custkey", 100), F.col("o_custkey").alias("pos"), F.concat(F.lit("m"), (F.col("o_orderkey") % 12).cast("string")).alias("name"))
    asked = s.select(repo("s_suppkey"), at("faces", "s_suppkey", 20), F.col("s_suppkey").alias("pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s_suppkey") % 3)).alias("k"))
    asked = asked.select("repo", "path", "pos", F.concat(F.lit("m"), ((F.col("pos") * 7 + F.col("k")) % 12).cast("string")).alias("name"))
    embeds = s.where("s_suppkey % 16 >= 4").select(repo("s_suppkey"), at("faces", "s_suppkey", 20), F.col("s_suppkey").alias("pos"), F.concat(F.lit("I"), (F.col("s_suppkey") - 4).cast("string")).alias("name"), F.col("s_suppkey").alias("site"))
    return DF.Facts(symbols, imports, called.where("callee IS NOT NULL"), own.unionByName(asked), embeds, s.where("s_suppkey % 11 = 5").select(repo("s_suppkey"), at("faces", "s_suppkey", 20), F.col("s_suppkey").alias("pos")))


BUILD = """sy AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY pos) AS n FROM (
  SELECT 'r' || p_partkey % 4 AS repo, 'parts/' || p_size % 5 || '/' || p_partkey // 40 || '.go' AS path, replace(p_name, ' ', '_') AS name, p_partkey AS pos, 'function' AS form FROM part
  UNION ALL SELECT 'r' || c_custkey % 4, 'types/' || c_custkey // 100 || '.go', 'T' || c_custkey % 500, c_custkey, 'type' FROM customer
  UNION ALL SELECT 'r' || s_suppkey % 4, 'faces/' || s_suppkey // 20 || '.go', 'I' || s_suppkey, s_suppkey, 'interface' FROM supplier)),
s AS MATERIALIZED (SELECT repo, path, regexp_extract(path, '^(.*)/', 1) AS dir, name, pos, form, 'sym:' || path || '#' || name || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS id FROM sy),
im AS MATERIALIZED (SELECT repo, path, 'suppliers/' || l_suppkey AS import_path, min(pos) AS site FROM s JOIN lineitem ON form = 'function' AND pos = l_partkey GROUP BY ALL),
ca AS MATERIALIZED (SELECT * FROM (SELECT repo, path, dir, id, lead(name) OVER w AS callee, path || ':' || l_orderkey * 100 + row_number() OVER w AS location FROM lineitem JOIN s ON form = 'function' AND pos = l_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE callee IS NOT NULL),
cd AS (SELECT c.*, t.id AS target, CASE WHEN t.path = c.path THEN 0 WHEN t.dir = c.dir THEN 1 ELSE 2 END AS tier FROM ca c JOIN s t ON t.repo = c.repo AND t.form = 'function' AND t.name = c.callee QUALIFY tier = min(tier) OVER (PARTITION BY c.repo, c.location)),
i AS (SELECT * FROM s WHERE form = 'interface'),
ex AS MATERIALIZED (SELECT a.repo, a.id AS src, b.id AS dst, a.path || ':' || a.pos AS location, a.pos AS a, b.pos AS b FROM i a JOIN i b ON b.pos = a.pos - 4 WHERE a.pos % 16 >= 4),
rc AS (SELECT a, b FROM ex UNION SELECT rc.a, ex.b FROM rc JOIN ex ON ex.a = rc.b),
di AS (SELECT s_suppkey AS pos, 'm' || (s_suppkey * 7 + unnest(range(s_suppkey % 3 + 1))) % 12 AS name FROM supplier),
cl AS MATERIALIZED (SELECT DISTINCT pos, name FROM (SELECT pos, name FROM di UNION ALL SELECT rc.a, name FROM rc JOIN di ON di.pos = rc.b) WHERE pos % 11 <> 5 AND pos NOT IN (SELECT a FROM rc WHERE b % 11 = 5)),
ty AS MATERIALIZED (SELECT DISTINCT o_custkey AS pos, 'm' || o_orderkey % 12 AS name FROM orders),
need AS (SELECT pos, count(*) AS n FROM cl GROUP BY pos),
mt AS (SELECT t, i FROM (SELECT ty.pos AS t, cl.pos AS i, count(*) AS have FROM cl JOIN ty ON ty.name = cl.name AND ty.pos % 4 = cl.pos % 4 GROUP BY ALL) JOIN need ON need.pos = i WHERE have = n),
e AS (SELECT repo, 'file:' || path AS src, id AS dst, 'DEFINES' AS kind, 1.0::DOUBLE AS confidence, NULL AS location, '0' AS block, '' AS path, '' AS step FROM s
  UNION ALL SELECT repo, 'file:' || path, 'pkg:' || import_path, 'IMPORTS', 1.0, path || ':' || site, '1', path, '0' FROM im
  UNION ALL SELECT repo, id, target, 'CALLS', 0.9::DOUBLE / count(*) OVER (PARTITION BY repo, location), location, '1', path, '1' FROM cd
  UNION ALL SELECT repo, src, dst, 'EXTENDS', 0.9, location, '1', regexp_extract(location, '^(.*):', 1), '2' FROM ex
  UNION ALL SELECT t.repo, t.id, i.id, 'IMPLEMENTS', 0.5, NULL, '2', '', '' FROM mt JOIN s t ON t.form = 'type' AND t.pos = mt.t JOIN i ON i.pos = mt.i),
nd AS (SELECT DISTINCT repo, 'file:' || path AS id, 'File' AS kind FROM s UNION ALL SELECT repo, id, 'Symbol' FROM s UNION ALL SELECT DISTINCT repo, 'pkg:' || import_path, 'Package' FROM im)
SELECT repo, kind, id AS src, NULL AS dst, NULL::DOUBLE AS confidence, NULL AS location, NULL AS edge_seq FROM nd
UNION ALL SELECT repo, kind, src, dst, confidence, location, concat_ws(chr(1), block, path, step, CASE WHEN location IS NULL THEN '' ELSE lpad(regexp_extract(location, ':([0-9]+)$', 1), 12, '0') END, src, dst) FROM e"""


@query("x_build_graph", "WITH RECURSIVE " + BUILD)
def x_build_graph(spark, d):
    """Nodes, and edges of all phases."""
    built = DF.build_graph(facts(spark, d))
    none = F.lit(None).cast("string")
    nodes = built.nodes.select("repo", "kind", F.col("id").alias("src"), none.alias("dst"), F.lit(None).cast("double").alias("confidence"), none.alias("location"), none.alias("edge_seq"))
    return nodes.unionByName(built.all_edges().select("repo", "kind", "src", "dst", "confidence", "location", "edge_seq"))


@query("x_pointer_log", """WITH o AS (SELECT o_custkey AS repo, o_orderkey % 9 AS fence, CASE WHEN o_orderkey % 13 <> 0 THEN row_number() OVER w END AS version, sha1(CAST(o_orderkey AS VARCHAR)) AS revision FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT *, max(fence) OVER (PARTITION BY repo ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o WHERE version IS NOT NULL)
SELECT repo, version, revision, fence FROM b WHERE before IS NULL OR fence >= before QUALIFY row_number() OVER (PARTITION BY repo ORDER BY version DESC) = 1""")
def x_pointer_log(spark, d):
    """Customers' orders as versions of a pointer, written as a store's log; some are torn, some of workers that were fenced off."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = X.table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.row_number().over(line).cast("long").alias("version"), F.sha1(F.col("o_orderkey").cast("string")).alias("revision"), (F.col("o_orderkey") % 9).alias("fence"), (F.col("o_orderkey") % 13 == 0).alias("torn"))
    text = F.to_json(F.struct("repo", "version", "revision", "fence"))
    store = FS.Store(spark, scratch(spark, "store"))
    o.select(F.when(F.col("torn"), F.substring(text, 1, 20)).otherwise(text)).write.text(f"{store.root}/pointers")
    return store.pointers()


LEASE = 12 * 3600


@query("s_lease_log", f"""WITH RECURSIVE r AS MATERIALIZED (SELECT user_id AS job, epoch_us(ts) AS ts, event_id AS id, event_id % 3 AS worker, event_type = 'purchase' AS settles, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT job, ts, id, n, worker AS asks, 'claimed' AS op, worker AS holder, ts + {LEASE * 1000000}::BIGINT AS until, CAST(1 AS BIGINT) AS fence FROM r WHERE n = 1 UNION ALL
SELECT r.job, r.ts, r.id, r.n, r.worker, CASE WHEN holder IS NULL OR r.ts >= until THEN 'claimed' WHEN holder <> r.worker THEN 'refused' WHEN settles THEN 'settled' ELSE 'renewed' END,
  CASE WHEN holder IS NULL OR r.ts >= until THEN r.worker WHEN holder = r.worker AND settles THEN NULL ELSE holder END,
  CASE WHEN holder IS NULL OR r.ts >= until OR (holder = r.worker AND NOT settles) THEN r.ts + {LEASE * 1000000}::BIGINT ELSE until END, fence + CASE WHEN holder IS NULL OR r.ts >= until THEN 1 ELSE 0 END FROM f JOIN r ON r.job = f.job AND r.n = f.n + 1),
x AS (SELECT *, lead(ts) OVER (PARTITION BY job ORDER BY n) AS next FROM f)
SELECT job, ts, id, op, asks AS worker, fence FROM f UNION ALL SELECT job, until, NULL, 'expired', holder, fence FROM x WHERE holder IS NOT NULL AND (next IS NULL OR next >= until)""")
def s_lease_log(spark, d):
    return LS.lease_log(lease_requests(X.table(spark, d, "events")), LEASE)


def lease_requests(events):
    """Users as jobs that three workers ask for; a purchase settles."""
    return events.select(F.col("user_id").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("worker"), (F.col("event_type") == "purchase").alias("settles"))

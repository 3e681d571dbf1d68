"""SQL that builds the fixtures on the driver's tables, to put in front of oracle queries. Written apart from the DataFrame code."""

PARTS = r"""parts AS (SELECT p_partkey, 'parts/' || lower(replace(p_brand, '#', '')) || '/' || p_partkey || '.go' AS path, replace(p_name, ' ', '_') AS name FROM part),
p AS (SELECT p_partkey, path, name, 'file:' || path AS file_id, 'sym:' || path || '#' || name AS symbol_id, regexp_extract(path, '^(.*)/', 1) AS dir FROM parts)"""

CALLS = r"""refs0 AS (SELECT l_orderkey, path, symbol_id, file_id, dir, row_number() OVER w AS rn, lead(name) OVER w AS callee
  FROM lineitem JOIN p ON l_partkey = p_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
refs AS (SELECT l_orderkey || ':' || rn AS ref_id, symbol_id AS caller_id, file_id, dir, callee, path || ':' || l_orderkey || ':' || rn AS location FROM refs0 WHERE callee IS NOT NULL),
cand AS (SELECT r.*, d.symbol_id AS target, CASE WHEN d.file_id = r.file_id THEN 0 WHEN d.dir = r.dir THEN 1 ELSE 2 END AS tier FROM refs r JOIN p d ON d.name = r.callee),
best AS (SELECT * FROM cand QUALIFY tier = min(tier) OVER (PARTITION BY ref_id)),
calls AS MATERIALIZED (SELECT caller_id AS src, target AS dst, 0.9::DOUBLE / count(*) OVER (PARTITION BY ref_id) AS confidence, location, ref_id, tier FROM best)"""

NODES = r"""nodes AS (
  SELECT 'commit:' || sha1(CAST(o_orderkey AS VARCHAR)) AS id, 'Commit' AS kind, o_orderpriority || ' ' || o_orderstatus AS name, NULL::VARCHAR AS path, CAST(epoch(o_orderdate) AS BIGINT) AS committed_at FROM orders
  UNION ALL SELECT 'contributor:' || lower(replace(c_name, '#', '.')) || '@example.com', 'Contributor', c_name, NULL, NULL FROM customer
  UNION ALL SELECT file_id, 'File', p_partkey || '.go', path, NULL FROM p
  UNION ALL SELECT symbol_id, 'Symbol', name, path, NULL FROM p
  UNION ALL SELECT 'pkg:' || n, 'Package', n, NULL, NULL FROM (SELECT DISTINCT 'suppliers/' || l_suppkey AS n FROM lineitem UNION ALL SELECT 'runtime'))"""

EDGES0 = r"""edges0 AS (
  SELECT DISTINCT 'commit:' || sha1(CAST(l_orderkey AS VARCHAR)) AS src, file_id AS dst, 'TOUCHES' AS kind, 'extracted' AS provenance, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS location FROM lineitem JOIN p ON l_partkey = p_partkey
  UNION ALL SELECT 'contributor:' || lower(replace(c_name, '#', '.')) || '@example.com', 'commit:' || sha1(CAST(o_orderkey AS VARCHAR)), 'AUTHORED', 'extracted', 1.0, NULL FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT file_id, symbol_id, 'DEFINES', 'syntactic', 1.0, NULL FROM p
  UNION ALL SELECT DISTINCT file_id, 'pkg:suppliers/' || l_suppkey, 'IMPORTS', 'syntactic', 1.0, NULL FROM lineitem JOIN p ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT file_id, 'pkg:runtime', 'IMPORTS', 'syntactic', 1.0, NULL FROM lineitem JOIN p ON l_partkey = p_partkey WHERE l_returnflag = 'R'
  UNION ALL SELECT src, dst, 'CALLS', 'syntactic', confidence, location FROM calls)"""

SEQ = r"edges AS MATERIALIZED (SELECT *, concat_ws(chr(1), kind, src, dst, coalesce(location, '')) AS edge_seq FROM edges0)"

GRAPH = ",\n".join((PARTS, CALLS, NODES, EDGES0, SEQ))

CONTROL = r"""forges AS (SELECT CAST(r_regionkey AS BIGINT) AS forge_id, 'https://' || replace(lower(r_name), ' ', '-') || '.example' AS base_url, CAST(60 * (r_regionkey + 1) AS BIGINT) AS rate_budget FROM region),
repos AS (SELECT c_custkey AS repo_id, forge_id, base_url, lower(n_name) || '/' || c_custkey AS slug, CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'private' END AS visibility,
  CASE WHEN c_custkey % 5 <> 0 THEN sha1(CAST(c_custkey AS VARCHAR)) END AS last_synced_commit, rtrim(substr(base_url, 9), '/') || '/' || lower(n_name) || '/' || c_custkey AS qualifier
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN forges ON n_regionkey = forge_id),
rules(rule_id, pattern, action, applies_to_private, created_at) AS (VALUES (1, '*/1*', 'include', true, 100), (2, 'nation_1*/*', 'exclude', false, 200), (3, 'nation_?/*', 'include', false, 300), (4, '*', 'exclude', false, 50), (5, 'nation_2/*', 'exclude', true, 400), (6, 'nation_?/*', 'exclude', true, 350)),
jobs0 AS (SELECT o_orderkey AS job_id, o_custkey AS repo_id, CASE WHEN o_orderkey % 2 = 0 THEN 'fetch' ELSE 'index' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'leased' END AS state, o_orderkey % 9 AS attempts, CAST(epoch(o_orderdate) AS BIGINT) AS run_after FROM orders),
jobs AS (SELECT *, CASE WHEN state = 'leased' THEN run_after + 300 END AS lease_until FROM jobs0 QUALIFY state = 'done' OR row_number() OVER (PARTITION BY repo_id, kind, state = 'done' ORDER BY run_after DESC, job_id DESC) = 1),
shards AS (SELECT o_orderkey AS shard_id, o_custkey AS repo_id, sha1(CAST(o_orderkey AS VARCHAR)) || '-syntactic-' || CASE WHEN o_orderkey % 7 = 0 THEN 'v6' ELSE 'v7' END AS revision, sha1(CAST(o_orderkey AS VARCHAR)) AS commit_sha,
  CAST(epoch(o_orderdate) AS BIGINT) AS published_at, CAST(epoch(lead(o_orderdate) OVER w) AS BIGINT) AS superseded_at, lead(o_orderdate) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""

NOW = 883612800


def _joined(views: str, sql: str) -> str:
    """sql is a SELECT, or starts with further views."""
    return f"WITH {views}{chr(10) if sql.startswith('SELECT') else ',' + chr(10)}{sql}"


def graph(sql: str) -> str:
    return _joined(GRAPH, sql)


def control(sql: str) -> str:
    return _joined(CONTROL, sql)

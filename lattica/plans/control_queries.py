"""Queries of the control plane on the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.operators import control as C
from lattica.plans import fixtures as X
from lattica.plans import oracle_views as V
from lattica.plans.registry import query

NOW = X.NOW


@query("c_qualifier", V.control("SELECT repo_id, qualifier FROM repos"))
def c_qualifier(spark, d):
    return X.repos(spark, d).select("repo_id", "qualifier")


@query("c_glob", V.control("""named AS (SELECT repo_id, CASE WHEN repo_id % 3 = 0 THEN replace(slug, '/', 'é/') ELSE slug END AS slug FROM repos),
globs(rule_id, pattern) AS (SELECT rule_id, pattern FROM rules UNION ALL VALUES (7, '*??/*'), (8, 'canad?/*'), (9, 'canad??/*'), (10, '*é/?'))
SELECT repo_id, rule_id FROM named, globs WHERE regexp_full_match(hex(encode(slug)), replace(replace(hex(encode(pattern)), '2A', '(..)*'), '3F', '..'))"""))
def c_glob(spark, d):
    globs = X.rules(spark).select("rule_id", "pattern").unionByName(spark.createDataFrame([(7, "*??/*"), (8, "canad?/*"), (9, "canad??/*"), (10, "*é/?")], "rule_id long, pattern string"))
    slug = F.when(F.col("repo_id") % 3 == 0, F.replace("slug", F.lit("/"), F.lit("é/"))).otherwise(F.col("slug"))
    each = X.repos(spark, d).select("repo_id", slug.alias("slug")).join(F.broadcast(globs), ids.glob_matches(F.col("pattern"), F.col("slug")))  # ten patterns
    return each.select("repo_id", "rule_id")


PRECEDENCE = """x0 AS (SELECT repo_id, rule_id, action, row_number() OVER (PARTITION BY repo_id ORDER BY length(pattern) DESC, created_at DESC, rule_id DESC) AS r FROM repos, rules WHERE regexp_full_match(slug, replace(replace(pattern, '*', '.*'), '?', '.'), 's') AND (visibility <> 'private' OR applies_to_private)),
st AS (SELECT r.repo_id, x.rule_id, CASE x.action WHEN 'include' THEN 'included' WHEN 'exclude' THEN 'excluded' ELSE CASE WHEN visibility = 'private' THEN 'discovered' ELSE 'included' END END AS state FROM repos r LEFT JOIN x0 x ON x.repo_id = r.repo_id AND x.r = 1)"""


@query("c_rule_precedence", V.control(PRECEDENCE + " SELECT * FROM st"))
def c_rule_precedence(spark, d):
    return C.rule_precedence(X.repos(spark, d), X.rules(spark))


@query("c_sha256", "SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def c_sha256(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("digest"))


@query("c_locator", r"SELECT page_id, CASE WHEN ok THEN lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) END AS base_url, CASE WHEN ok THEN rtrim(regexp_extract(url, '^https?://[^/]+/([^?#]+)$', 1), '/') END AS slug FROM (SELECT *, NOT regexp_matches(url, '[?#]') AS ok FROM pages)")
def c_locator(spark, d):
    return X.table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in ids.locator(F.col("url")).items()])


@query("c_job_state", V.control("SELECT job_id, CASE WHEN state = 'leased' THEN 'active' WHEN state = 'queued' AND attempts = 0 THEN 'queued' WHEN state = 'queued' THEN 'retrying' ELSE 'unknown' END AS word FROM jobs"))
def c_job_state(spark, d):
    return X.jobs(spark, d).select("job_id", ids.job_state(F.col("state"), F.col("attempts"), F.lit(True)).alias("word"))


@query("c_gc_eligible", V.control(f"SELECT shard_id FROM shards s WHERE NOT EXISTS (SELECT 1 FROM shards q WHERE q.is_current AND q.shard_id = s.shard_id) AND coalesce(superseded_at, published_at) < {NOW} - 3600"))
def c_gc_eligible(spark, d):
    s = X.shards(spark, d)
    return C.gc_eligible(s, s.where("is_current"), NOW).select("shard_id")


@query("c_prune_conflicts", V.control("SELECT repo_id, slug FROM repos WHERE NOT (slug IN (SELECT slug FROM repos WHERE repo_id % 3 = 0))"))
def c_prune_conflicts(spark, d):
    r = X.repos(spark, d)
    return r.join(r.where("repo_id % 3 = 0").select("slug"), "slug", "left_anti").select("repo_id", "slug")


STATE = "CASE WHEN {j}.state = 'leased' THEN 'active' WHEN {j}.state = 'queued' AND {j}.attempts = 0 THEN 'queued' WHEN {j}.state = 'queued' THEN 'retrying' WHEN {o} THEN 'done' ELSE 'never_ran' END"


@query("c_admin_status", V.control(f"SELECT r.slug, f.base_url, s.revision, {STATE.format(j='a', o='r.last_synced_commit IS NOT NULL')} AS fetch_state, {STATE.format(j='b', o='s.revision IS NOT NULL')} AS index_state FROM repos r JOIN forges f USING (forge_id) LEFT JOIN shards s ON s.repo_id = r.repo_id AND s.is_current LEFT JOIN jobs a ON a.repo_id = r.repo_id AND a.kind = 'fetch' AND a.state <> 'done' LEFT JOIN jobs b ON b.repo_id = r.repo_id AND b.kind = 'index' AND b.state <> 'done'"))
def c_admin_status(spark, d):
    return C.admin_status(X.repos(spark, d), X.forges(spark, d), X.shards(spark, d), X.jobs(spark, d))


@query("c_conflicts", V.control("SELECT f.base_url, n_name AS org, a.slug, b.slug AS other FROM repos a JOIN forges f USING (forge_id) JOIN customer c ON c_custkey = a.repo_id JOIN nation ON n_nationkey = c_nationkey JOIN repos b ON b.forge_id = a.forge_id AND b.repo_id = a.repo_id + 25"))
def c_conflicts(spark, d):
    r, org = X.repos(spark, d), X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("repo_id"), F.col("n_name").alias("org"))
    other = r.select("forge_id", (F.col("repo_id") - 25).alias("repo_id"), F.col("slug").alias("other"))
    return r.drop("base_url").join(X.forges(spark, d), "forge_id").join(org, "repo_id").join(other, ["forge_id", "repo_id"]).select("base_url", "org", "slug", "other")


@query("c_verb_target", V.control(PRECEDENCE + " SELECT qualifier, repo_id, revision FROM repos JOIN st USING (repo_id) LEFT JOIN shards s USING (repo_id) WHERE st.state = 'included' AND coalesce(s.is_current, true)"))
def c_verb_target(spark, d):
    r = X.repos(spark, d)
    kept = r.join(C.rule_precedence(r, X.rules(spark)).where("state = 'included'"), "repo_id", "left_semi")
    return kept.join(X.shards(spark, d).where("is_current"), "repo_id", "left").select("qualifier", "repo_id", "revision")


@query("c_indexed_repos", V.control("SELECT qualifier, revision FROM repos JOIN shards USING (repo_id) WHERE is_current AND suffix(revision, '-v7')"))
def c_indexed_repos(spark, d):
    return X.repos(spark, d).join(X.shards(spark, d).where(F.col("is_current") & F.col("revision").endswith("-v7")), "repo_id").select("qualifier", "revision")


@query("c_indexed_count", V.control("SELECT CAST(count(*) AS BIGINT) AS n FROM shards WHERE is_current"))
def c_indexed_count(spark, d):
    return X.shards(spark, d).where("is_current").agg(F.count(F.lit(1)).alias("n"))


@query("c_outdated_shards", V.control("SELECT repo_id, revision FROM repos JOIN shards USING (repo_id) WHERE is_current AND last_synced_commit IS NOT NULL AND right(revision, 3) <> '-v7'"))
def c_outdated_shards(spark, d):
    return X.repos(spark, d).where("last_synced_commit IS NOT NULL").join(X.shards(spark, d).where(F.col("is_current") & ~F.col("revision").endswith("-v7")), "repo_id").select("repo_id", "revision")


@query("c_claim_job", V.control(f"SELECT job_id, kind, repo_id, slug, attempts + 1 AS attempts, CAST({NOW} + 300 AS BIGINT) AS lease_until, {NOW} - run_after AS latency FROM jobs JOIN repos USING (repo_id) WHERE (state = 'queued' AND run_after <= {NOW}) OR (state = 'leased' AND lease_until <= {NOW}) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY run_after, job_id) = 1"))
def c_claim_job(spark, d):
    return C.claim(X.jobs(spark, d), X.repos(spark, d), NOW)


@query("c_claim_order", V.control(f"SELECT job_id, kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY run_after, job_id) AS BIGINT) AS place FROM jobs WHERE (state = 'queued' AND run_after <= {NOW}) OR (state = 'leased' AND lease_until <= {NOW})"))
def c_claim_order(spark, d):
    from pyspark.sql.window import Window

    return C.claimable(X.jobs(spark, d), NOW).select("job_id", "kind", F.row_number().over(Window.partitionBy("kind").orderBy("run_after", "job_id")).cast("long").alias("place"))


OBJECTS = f"obj AS (SELECT 'shards/' || o_custkey || '/' || CASE WHEN o_orderkey % 13 = 0 THEN 'lost-' || o_orderkey ELSE sha1(CAST(o_orderkey AS VARCHAR)) || '-syntactic-' || CASE WHEN o_orderkey % 7 = 0 THEN 'v6' ELSE 'v7' END END || '/' || f AS key, CAST(epoch(o_orderdate) AS BIGINT) AS modified FROM orders, (SELECT unnest(['manifest.json', 'fts.tar']) AS f))"


def objects(spark, d):
    o = X.table(spark, d, "orders")
    revision = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("lost-"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.sha1(F.col("o_orderkey").cast("string")), F.lit("-syntactic-"), F.when(F.col("o_orderkey") % 7 == 0, "v6").otherwise("v7")))
    rows = o.select("o_orderkey", "o_custkey", "o_orderdate", revision.alias("revision"), F.explode(F.array(F.lit("manifest.json"), F.lit("fts.tar"))).alias("f"))
    return rows.select(F.concat_ws("/", F.lit("shards"), F.col("o_custkey").cast("string"), "revision", "f").alias("key"), X.seconds("o_orderdate").alias("modified"))


@query("c_orphan_parse", f"WITH {OBJECTS} SELECT key, split_part(key, '/', 2) AS repo, split_part(key, '/', 3) AS revision, split_part(key, '/', 4) AS file FROM obj")
def c_orphan_parse(spark, d):
    part = lambda i: F.regexp_extract("key", r"^shards/(\d+)/([^/]+)/([^/]+)$", i)
    return objects(spark, d).select("key", part(1).alias("repo"), part(2).alias("revision"), part(3).alias("file"))


@query("c_orphans", V.control(OBJECTS + f", x1 AS (SELECT CAST(split_part(key, '/', 2) AS BIGINT) AS repo_id, split_part(key, '/', 3) AS revision, max(modified) AS newest FROM obj GROUP BY ALL) SELECT repo_id, revision FROM x1 WHERE newest <= {NOW} - 21600 AND NOT EXISTS (SELECT 1 FROM shards s WHERE s.repo_id = x1.repo_id AND s.revision = x1.revision) ORDER BY repo_id, revision LIMIT 100"))
def c_orphans(spark, d):
    return C.orphans(objects(spark, d), X.shards(spark, d), NOW).select("repo_id", "revision")


@query("c_queue_depth", V.control("SELECT k.kind, CAST(count(j.job_id) AS BIGINT) AS depth FROM (SELECT unnest(['fetch', 'index']) AS kind) k LEFT JOIN jobs j ON j.kind = k.kind AND j.state <> 'done' GROUP BY k.kind"))
def c_queue_depth(spark, d):
    return C.queue_depth(X.jobs(spark, d))


@query("c_visibility_counts", V.control("SELECT CAST(count(*) FILTER (visibility = 'public') AS BIGINT) AS n_public, CAST(count(*) FILTER (visibility = 'internal') AS BIGINT) AS n_internal, CAST(count(*) FILTER (visibility = 'private') AS BIGINT) AS n_private FROM repos"))
def c_visibility_counts(spark, d):
    return X.repos(spark, d).agg(*[F.count_if(F.col("visibility") == v).alias(f"n_{v}") for v in ("public", "internal", "private")])


@query("c_visibility_map", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'internal' WHEN c_custkey % 3 = 0 THEN 'private' ELSE 'public' END AS visibility FROM customer")
def c_visibility_map(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", C.visibility(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 7 == 0).alias("visibility"))


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@query("c_histogram", "SELECT le, CAST(count(*) FILTER (value <= le) AS BIGINT) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le) GROUP BY le")
def c_histogram(spark, d):
    return C.histogram(X.table(spark, d, "events"), "value", BOUNDS)


@query("c_enqueue", V.control("SELECT DISTINCT repo_id, 'fetch' AS kind FROM repos WHERE repo_id % 2 = 0 AND repo_id NOT IN (SELECT repo_id FROM jobs WHERE kind = 'fetch' AND state <> 'done')"))
def c_enqueue(spark, d):
    return C.enqueue(X.jobs(spark, d), X.repos(spark, d).where("repo_id % 2 = 0").withColumn("kind", F.lit("fetch")))


@query("c_backoff", V.control("SELECT job_id, CAST(least(30 * pow(2, least(attempts, 7)), 3600) AS BIGINT) AS seconds FROM jobs"))
def c_backoff(spark, d):
    return X.jobs(spark, d).select("job_id", ids.backoff_seconds(F.col("attempts")).alias("seconds"))


@query("c_poll_schedule", V.control(f"SELECT repo_id, {NOW} + CAST(floor(i * (1 + 0.2::DOUBLE * (h::DOUBLE / 65536))) AS BIGINT) AS next_poll_at FROM (SELECT repo_id, CASE WHEN repo_id % 4 = 0 THEN 60 ELSE 300 END AS i, CAST('0x' || substr(sha1(qualifier), 1, 4) AS INTEGER) AS h FROM repos)"))
def c_poll_schedule(spark, d):
    interval = F.when(F.col("repo_id") % 4 == 0, 60)
    return C.poll_schedule(X.repos(spark, d).withColumn("poll_interval_seconds", interval), NOW)


@query("c_job_retention", V.control(f"SELECT job_id FROM jobs WHERE state = 'done' AND run_after + 60 < {NOW} - 604800"))
def c_job_retention(spark, d):
    return X.jobs(spark, d).withColumn("finished_at", F.when(F.col("state") == "done", F.col("run_after") + 60)).where(f"state = 'done' AND finished_at < {NOW} - 604800").select("job_id")


@query("c_token_status", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'revoked' WHEN epoch(o_orderdate) <= {NOW} THEN 'expired' ELSE 'active' END AS status FROM orders")
def c_token_status(spark, d):
    revoked = F.when(F.col("o_orderkey") % 5 == 0, F.lit(1))
    return X.table(spark, d, "orders").select("o_orderkey", ids.token_status(revoked, X.seconds("o_orderdate"), F.lit(NOW)).alias("status"))


@query("c_retry_after", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN greatest(o_orderkey % 100, 5) WHEN 1 THEN greatest(CAST(epoch(o_orderdate) AS BIGINT) - {NOW}, 5) WHEN 2 THEN 300 ELSE greatest(o_orderkey % 100, o_orderkey % 70, 5) END AS wait FROM orders")
def c_retry_after(spark, d):
    n, k = F.col("o_orderkey") % 4, F.col("o_orderkey") % 100
    header = F.when((n == 0) | (n == 3), k.cast("string")).when(n == 1, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    reset = F.when(n == 3, F.lit(NOW) + F.col("o_orderkey") % 70)
    return X.table(spark, d, "orders").select("o_orderkey", ids.retry_after(header, reset, F.lit(NOW)).alias("wait"))


DIFF = """, x1 AS (SELECT forge_id, slug, visibility FROM repos WHERE repo_id % 4 <> 0), x2 AS (SELECT forge_id, slug, CASE WHEN repo_id % 2 = 0 THEN 'included' ELSE 'excluded' END AS old FROM repos WHERE repo_id % 3 <> 0), x3 AS (SELECT slug, state FROM repos JOIN st USING (repo_id))
SELECT coalesce(x1.slug, x2.slug) AS slug, CASE WHEN x1.slug IS NULL THEN 'missing' WHEN x2.slug IS NULL THEN 'insert' WHEN old <> x3.state THEN 'update' ELSE 'keep' END AS action, coalesce(x1.slug IS NOT NULL AND x3.state = 'included' AND coalesce(old, '') <> 'included', false) AS enqueue, coalesce(x1.slug IS NOT NULL AND old = 'included' AND x3.state <> 'included', false) AS remove
FROM x1 FULL JOIN x2 ON x1.forge_id = x2.forge_id AND x1.slug = x2.slug LEFT JOIN x3 ON x3.slug = coalesce(x1.slug, x2.slug)"""


@query("c_discovery_diff", V.control(PRECEDENCE + DIFF))
def c_discovery_diff(spark, d):
    r = X.repos(spark, d)
    states = r.join(C.rule_precedence(r, X.rules(spark)), "repo_id").select("slug", F.col("state").alias("new_state"))
    registry = r.where("repo_id % 3 <> 0").withColumn("state", F.when(F.col("repo_id") % 2 == 0, "included").otherwise("excluded"))
    return C.discovery_diff(r.where("repo_id % 4 <> 0").select("forge_id", "slug", "visibility"), registry, states)


RESULTS = """res AS (SELECT job_id, CASE WHEN job_id % 5 = 0 THEN lease_until - 1 ELSE lease_until END AS token, (['done', 'released', 'failed'])[1 + job_id % 3] AS outcome, 'e' || job_id AS error FROM jobs WHERE job_id % 4 <> 3)"""


def results(spark, d):
    jobs = X.jobs(spark, d).where("job_id % 4 <> 3")
    token = F.when(F.col("job_id") % 5 == 0, F.col("lease_until") - 1).otherwise(F.col("lease_until"))
    outcome = F.element_at(F.array(*map(F.lit, ("done", "released", "failed"))), (F.col("job_id") % 3 + 1).cast("int"))
    return jobs.select("job_id", token.alias("token"), outcome.alias("outcome"), F.concat(F.lit("e"), F.col("job_id").cast("string")).alias("error"))


@query("c_settle_jobs", V.control(RESULTS + f""", x0 AS (SELECT j.*, r.job_id AS r_id, outcome, error, coalesce(state = 'leased' AND lease_until = token, false) AS fits FROM jobs j LEFT JOIN res r ON r.job_id = j.job_id)
SELECT job_id, CASE WHEN fits THEN CASE outcome WHEN 'done' THEN 'done' ELSE 'queued' END ELSE state END AS state, CASE WHEN NOT fits THEN attempts WHEN outcome = 'failed' THEN attempts + 1 WHEN outcome = 'released' THEN 0 ELSE attempts END AS attempts,
CASE WHEN NOT fits THEN run_after WHEN outcome = 'failed' THEN {NOW} + CAST(least(30 * pow(2, least(attempts, 7)), 3600) AS BIGINT) ELSE {NOW} END AS run_after, CASE WHEN NOT fits THEN lease_until END AS lease_until,
CASE WHEN fits AND outcome = 'failed' THEN error END AS last_error, CASE WHEN fits AND outcome = 'done' THEN CAST({NOW} AS BIGINT) END AS finished_at, CASE WHEN r_id IS NOT NULL THEN fits END AS applied FROM x0"""))
def c_settle_jobs(spark, d):
    none = F.lit(None)
    jobs = X.jobs(spark, d).withColumns({"last_error": none.cast("string"), "finished_at": none.cast("long")})
    return C.settle_jobs(jobs, results(spark, d), NOW).select("job_id", "state", "attempts", "run_after", "lease_until", "last_error", "finished_at", "applied")


@query("c_renew_lease", V.control(RESULTS + f" SELECT j.job_id, CASE WHEN coalesce(state = 'leased' AND lease_until = token, false) THEN CAST({NOW} + 300 AS BIGINT) ELSE lease_until END AS lease_until, CASE WHEN r.job_id IS NOT NULL THEN coalesce(state = 'leased' AND lease_until = token, false) END AS applied FROM jobs j LEFT JOIN res r ON r.job_id = j.job_id"))
def c_renew_lease(spark, d):
    return C.renew(X.jobs(spark, d), results(spark, d).select("job_id", "token"), NOW).select("job_id", "lease_until", "applied")


@query("c_reclaim", V.control(f"""x0 AS (SELECT *, CASE WHEN shard_id % 4 = 0 THEN 'reclaiming' ELSE 'published' END AS state, NOT is_current AS free, shard_id % 3 = 0 AS gone FROM shards)
SELECT shard_id, CASE WHEN state = 'published' AND free AND coalesce(superseded_at, published_at) < {NOW} - 3600 THEN 'reclaiming' ELSE state END AS state FROM x0 WHERE NOT (state = 'reclaiming' AND free AND gone)"""))
def c_reclaim(spark, d):
    s = X.shards(spark, d)
    states = s.withColumn("state", F.when(F.col("shard_id") % 4 == 0, "reclaiming").otherwise("published"))
    return C.reclaim(states, s.where("is_current"), s.where("shard_id % 3 = 0").select("shard_id"), NOW).select("shard_id", "state")


#: A sweep in which nations are organisations: three of four repositories are listed, a seventh under a second forge of the same host, a tenth under both.
SWEEP = """li AS (SELECT c_nationkey AS org_id, forge_id + CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 0 END AS forge_id, slug, qualifier, st.state FROM repos JOIN customer ON c_custkey = repo_id JOIN st USING (repo_id) WHERE repo_id % 4 <> 0
  UNION ALL SELECT c_nationkey + 1000, forge_id + 200, slug, qualifier, st.state FROM repos JOIN customer ON c_custkey = repo_id JOIN st USING (repo_id) WHERE repo_id % 10 = 0),
re AS (SELECT repo_id, forge_id, slug, qualifier, CASE WHEN repo_id % 2 = 0 THEN 'included' ELSE 'excluded' END AS state FROM repos WHERE repo_id % 3 <> 0),
cf AS (SELECT c_nationkey AS org_id, slug FROM repos JOIN customer ON c_custkey = repo_id WHERE repo_id % 5 = 0),
j AS (SELECT li.*, o.repo_id AS own, n.repo_id AS other, o.state AS old FROM li LEFT JOIN re o ON o.forge_id = li.forge_id AND o.slug = li.slug LEFT JOIN re n ON n.qualifier = li.qualifier),
f AS (SELECT qualifier, org_id AS f_org, slug AS f_slug, forge_id AS f_forge FROM j WHERE own IS NULL AND other IS NULL QUALIFY row_number() OVER (PARTITION BY qualifier ORDER BY org_id, slug, forge_id) = 1),
a AS (SELECT j.*, f_org, f_slug, f_forge, CASE WHEN own IS NOT NULL THEN 'update' WHEN other IS NOT NULL OR (f_org, f_slug, f_forge) <> (j.org_id, j.slug, j.forge_id) THEN 'conflict' ELSE 'insert' END AS action FROM j LEFT JOIN f USING (qualifier))
SELECT org_id, slug, action, CASE WHEN action = 'update' THEN own WHEN action = 'conflict' THEN other END AS repo_id, CASE WHEN action = 'conflict' AND other IS NULL THEN f_forge END AS with_forge, CASE WHEN action = 'conflict' AND other IS NULL THEN f_slug END AS with_slug,
  action <> 'conflict' AND state = 'included' AND coalesce(old, '') <> 'included' AS enqueue, action = 'update' AND coalesce(old, '') = 'included' AND state <> 'included' AS remove FROM a
UNION ALL SELECT org_id, slug, 'resolved', NULL, NULL, NULL, false, false FROM cf WHERE (org_id, slug) NOT IN (SELECT (org_id, slug) FROM a WHERE action = 'conflict')"""


@query("c_discovery_conflicts", V.control(PRECEDENCE + ",\n" + SWEEP))
def c_discovery_conflicts(spark, d):
    r = X.repos(spark, d)
    states = C.rule_precedence(r, X.rules(spark)).select("repo_id", "state")
    org = X.table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_nationkey").cast("long").alias("org_id"))
    rows = r.join(org, "repo_id").join(states, "repo_id")
    one = rows.where("repo_id % 4 <> 0").withColumn("forge_id", F.col("forge_id") + F.when(F.col("repo_id") % 7 == 0, 100).otherwise(0))
    two = rows.where("repo_id % 10 = 0").withColumns({"forge_id": F.col("forge_id") + 200, "org_id": F.col("org_id") + 1000})
    columns = ["org_id", "forge_id", "slug", "qualifier", "state"]
    registry = r.where("repo_id % 3 <> 0").select("repo_id", "forge_id", "slug", "qualifier", F.when(F.col("repo_id") % 2 == 0, "included").otherwise("excluded").alias("state"))
    return C.discover(one.select(columns).unionByName(two.select(columns)), registry, rows.where("repo_id % 5 = 0").select("org_id", "slug"))


NEW_RULES = (*X.RULES[:4], (7, "nation_3/1?", "exclude", True, 500), (6, "nation_?/*", "include", True, 350))


def _state_sql(rules: tuple, name: str) -> str:
    values = ", ".join(f"({i}, '{p}', '{a}', {str(x).lower()}, {t})" for i, p, a, x, t in rules)
    return f"""{name}_r(rule_id, pattern, action, applies_to_private, created_at) AS (VALUES {values}),
{name} AS (SELECT repo_id, CASE action WHEN 'include' THEN 'included' WHEN 'exclude' THEN 'excluded' ELSE CASE WHEN visibility = 'private' THEN 'discovered' ELSE 'included' END END AS state FROM (SELECT p.repo_id, p.visibility, action FROM repos p LEFT JOIN {name}_r r ON regexp_full_match(slug, replace(replace(pattern, '*', '.*'), '?', '.'), 's') AND (visibility <> 'private' OR applies_to_private)
  QUALIFY row_number() OVER (PARTITION BY p.repo_id ORDER BY length(pattern) DESC, created_at DESC, rule_id DESC) = 1))"""


@query("c_rule_delta", V.control(f"{_state_sql(X.RULES, 'ra')},\n{_state_sql(NEW_RULES, 'rb')}\nSELECT ra.repo_id, ra.state AS old_state, rb.state FROM ra JOIN rb USING (repo_id) WHERE ra.state <> rb.state"))
def c_rule_delta(spark, d):
    after = spark.createDataFrame(NEW_RULES, X.rules(spark).schema)
    return C.rule_delta(X.repos(spark, d), X.rules(spark), after)

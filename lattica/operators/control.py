"""The control plane's dataflows: rules, queue, status, garbage collection, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import ids
from lattica.schema import JOB_KINDS

MAX_RULES = 10_000


def rule_precedence(repos: DataFrame, rules: DataFrame) -> DataFrame:
    """repo_id, rule_id, state: the rule with the longest matching pattern, then the newest, then the largest id, decides; private
    repositories consider rules that apply to them only. Without a rule private ones are discovered, others included.

    The rules, a short list (more than MAX_RULES are an error), are gathered in one row's array, ordered by precedence; a repository takes the
    first that matches.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    order = F.struct((-F.length("pattern")).alias("a"), (-F.col("created_at")).alias("b"), (-F.col("rule_id")).alias("c"), "rule_id", "pattern", "action", "applies_to_private")
    ordered = rules.agg(F.sort_array(F.collect_list(order)).alias("rules"))
    private = F.col("visibility") == "private"
    fits = F.filter("rules", lambda r: ids.glob_matches(r["pattern"], F.col("slug")) & (~private | r["applies_to_private"]))
    told = repos.crossJoin(F.broadcast(ordered)).withColumn("rule", F.get(fits, 0))  # one row, the rule list
    state = F.when(F.col("rule.action") == "include", "included").when(F.col("rule.action") == "exclude", "excluded").otherwise(F.when(private, "discovered").otherwise("included"))
    return told.select("repo_id", F.col("rule.rule_id").alias("rule_id"), state.alias("state"))


def claimable(jobs: DataFrame, now: int) -> DataFrame:
    """Queued jobs that are due, and leased ones whose lease has ended."""
    return jobs.where(((F.col("state") == "queued") & (F.col("run_after") <= now)) | ((F.col("state") == "leased") & (F.col("lease_until") <= now)))


def claim(jobs: DataFrame, repos: DataFrame, now: int, lease: int = 300) -> DataFrame:
    """The most overdue claimable job of each kind, claimed: job_id, kind, repo_id, slug, attempts (the fencing token), lease_until, latency."""
    due = claimable(jobs, now).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("run_after", "job_id"))).where("r = 1")
    return due.join(repos.select("repo_id", "slug"), "repo_id").select("job_id", "kind", "repo_id", "slug", (F.col("attempts") + 1).alias("attempts"), F.lit(now + lease).cast("long").alias("lease_until"), (F.lit(now) - F.col("run_after")).alias("latency"))


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted (repo_id, kind) what no job that isn't done holds already, once each."""
    return wanted.select("repo_id", "kind").distinct().join(jobs.where("state <> 'done'"), ["repo_id", "kind"], "left_anti")


def _held(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs with the columns of results (job_id, token and others); fits tells whether the job is still leased under the token, the end of the lease that was claimed."""
    told = results.withColumnsRenamed({c: f"r_{c}" for c in results.columns})
    joined = jobs.join(told, jobs["job_id"] == told["r_job_id"], "left")
    return joined.withColumn("fits", F.coalesce((F.col("state") == "leased") & (F.col("lease_until") == F.col("r_token")), F.lit(False)))


def _changed(held: DataFrame, jobs: DataFrame, new: dict[str, Column]) -> DataFrame:
    return held.select(*[F.when(F.col("fits"), new[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in jobs.columns], F.when(F.col("r_job_id").isNotNull(), F.col("fits")).alias("applied"))


def renew(jobs: DataFrame, heartbeats: DataFrame, now: int, lease: int = 300) -> DataFrame:
    """jobs after heartbeats (job_id, token, one a job): a lease that still holds lasts from now on, and its end is the new token.

    applied: null without a heartbeat, false where the lease had gone to another worker or had ended otherwise.
    """
    return _changed(_held(jobs, heartbeats), jobs, {"lease_until": F.lit(now + lease)})


def settle_jobs(jobs: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """jobs (attempts, last_error, finished_at among their columns) after results (job_id, token, outcome, error, one a job) of their workers.

    outcome is done (finished), released (queued at once, with a clean slate) or failed (queued after a backoff that doubles with each attempt).
    A result whose lease no longer holds is discarded; applied is false then, and null without a result.
    """
    held, is_ = _held(jobs, results), lambda x: F.col("r_outcome") == x
    later = F.lit(now) + F.when(is_("failed"), ids.backoff_seconds(F.col("attempts"))).otherwise(0)
    return _changed(held, jobs, {
        "state": F.when(is_("done"), "done").otherwise("queued"), "lease_until": F.lit(None), "run_after": later,
        "attempts": F.when(is_("done"), F.col("attempts")).when(is_("failed"), F.col("attempts") + 1).otherwise(0),
        "last_error": F.when(is_("failed"), F.col("r_error")).when(is_("done"), F.col("last_error")), "finished_at": F.when(is_("done"), F.lit(now)),
    })


def reclaim(shards: DataFrame, pointers: DataFrame, deleted: DataFrame, now: int, grace: int = 3600) -> DataFrame:
    """shards (shard_id, state, published_at, superseded_at) after a round of garbage collection: eligible published ones are reclaiming, and
    reclaiming ones whose objects are gone (deleted: shard_id) are reaped. What a pointer (shard_id) names meanwhile is left as it is."""
    named, gone = (x.select("shard_id").distinct().withColumn(c, F.lit(True)) for x, c in ((pointers, "named"), (deleted, "gone")))
    told = shards.join(named, "shard_id", "left").join(gone, "shard_id", "left")
    free, due = F.col("named").isNull(), F.coalesce("superseded_at", "published_at") < now - grace
    reaped = free & (F.col("state") == "reclaiming") & F.col("gone").isNotNull()
    return told.where(~F.coalesce(reaped, F.lit(False))).withColumn("state", F.when(free & due & (F.col("state") == "published"), "reclaiming").otherwise(F.col("state"))).select(shards.columns)


def queue_depth(jobs: DataFrame) -> DataFrame:
    counts = jobs.where("state <> 'done'").groupBy("kind").agg(F.count(F.lit(1)).alias("depth"))
    kinds = jobs.sparkSession.createDataFrame([(k,) for k in JOB_KINDS], "kind string")
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def admin_status(repos: DataFrame, forges: DataFrame, shards: DataFrame, jobs: DataFrame) -> DataFrame:
    current = shards.where("is_current").select("repo_id", "revision")
    open_jobs = jobs.where("state <> 'done'")
    of = lambda kind: open_jobs.where(F.col("kind") == kind).select("repo_id", F.col("state").alias(f"{kind}_job"), F.col("attempts").alias(f"{kind}_attempts"))
    rows = repos.drop("base_url").join(forges, "forge_id").join(current, "repo_id", "left").join(of("fetch"), "repo_id", "left").join(of("index"), "repo_id", "left")
    state = lambda kind, output: ids.job_state(F.col(f"{kind}_job"), F.col(f"{kind}_attempts"), output)
    return rows.select("slug", "base_url", "revision", state("fetch", F.col("last_synced_commit").isNotNull()).alias("fetch_state"), state("index", F.col("revision").isNotNull()).alias("index_state"))


def gc_eligible(shards: DataFrame, pointers: DataFrame, now: int, grace: int = 3600) -> DataFrame:
    """Shards that no pointer (shard_id) names and that were superseded (or published, if never superseded) longer ago than grace."""
    return shards.join(pointers.select("shard_id"), "shard_id", "left_anti").where(F.coalesce("superseded_at", "published_at") < now - grace)


def orphans(objects: DataFrame, shards: DataFrame, now: int, age: int = 6 * 3600, cap: int = 100) -> DataFrame:
    """repo_id, revision of artifact prefixes (objects: key, modified) without a shard whose newest object is old enough; the first cap of them."""
    parsed = objects.select(F.regexp_extract("key", r"^shards/(\d+)/([^/]+)/[^/]+$", 1).alias("r"), F.regexp_extract("key", r"^shards/(\d+)/([^/]+)/[^/]+$", 2).alias("revision"), "modified").where("r <> ''")
    newest = parsed.groupBy(F.col("r").cast("long").alias("repo_id"), "revision").agg(F.max("modified").alias("newest"))
    return newest.where(F.col("newest") <= now - age).join(shards.select("repo_id", "revision"), ["repo_id", "revision"], "left_anti").orderBy("repo_id", "revision").limit(cap)


def discovery_diff(listing: DataFrame, registry: DataFrame, states: DataFrame) -> DataFrame:
    """What a listing (forge_id, slug, visibility) changes in the registry (repo_id, forge_id, slug, state), states: slug, new_state by rules:
    slug, action: insert, update, keep or missing, and whether to enqueue a fetch (newly included) or to remove (no longer included)."""
    both = listing.join(registry.select("forge_id", "slug", F.col("state").alias("old_state"), F.lit(True).alias("known")), ["forge_id", "slug"], "full_outer").join(states, "slug", "left")
    action = F.when(F.col("visibility").isNull(), "missing").when(F.col("known").isNull(), "insert").when(F.col("old_state") != F.col("new_state"), "update").otherwise("keep")
    there = F.col("visibility").isNotNull()
    return both.select("slug", action.alias("action"), F.coalesce(there & (F.col("new_state") == "included") & (F.col("old_state").isNull() | (F.col("old_state") != "included")), F.lit(False)).alias("enqueue"), F.coalesce(there & (F.col("old_state") == "included") & (F.col("new_state") != "included"), F.lit(False)).alias("remove"))


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """le, n: how many values are at most each bound, and infinity; one pass of conditional counts."""
    counts = values.agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(column).alias("inf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n"))]
    return counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def poll_schedule(repos: DataFrame, now: int, default: int = 300) -> DataFrame:
    """repo_id, next_poll_at: now and the interval with up to a fifth more, by a hash of the repository instead of chance."""
    interval = F.coalesce("poll_interval_seconds", F.lit(default))
    return repos.select("repo_id", (F.lit(now) + F.floor(interval * (1 + 0.2 * (F.conv(F.substring(F.sha1(F.col("qualifier").cast("binary")), 1, 4), 16, 10).cast("int") / 65536)))).cast("long").alias("next_poll_at"))


def visibility(private: Column, internal: Column) -> Column:
    return F.when(internal, "internal").when(private, "private").otherwise("public")


def discover(listing: DataFrame, registry: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What complete listings change: org_id, slug, action, repo_id, with_forge, with_slug, enqueue, remove.

    listing: org_id, forge_id, slug, qualifier, state (what the rules give); registry: repo_id, forge_id, slug, qualifier, state; conflicts: org_id,
    slug, the records of earlier sweeps. A full outer merge by the repository's own key and by its name:

    update: it is registered (repo_id); insert: neither it nor its name is. conflict: another repository has its name, a registered one
    (repo_id) or one of the same sweep (with_forge, with_slug), of which the first by (org_id, slug) is inserted. resolved: a record whose
    repository isn't listed any more, or has come in. Each listed repository is a row of its own, so that a conflict holds up no other. enqueue:
    it is included now and wasn't; remove: it was and isn't.
    """
    mine = registry.select("forge_id", "slug", F.col("repo_id").alias("own_id"), F.col("state").alias("old_state"))
    names = registry.select("qualifier", F.col("repo_id").alias("other_id"))
    told = listing.join(mine, ["forge_id", "slug"], "left").join(names, "qualifier", "left")
    free = F.col("own_id").isNull() & F.col("other_id").isNull()
    first = told.where(free).groupBy("qualifier").agg(F.min(F.struct("org_id", "slug", "forge_id")).alias("first"))
    told = told.join(first, "qualifier", "left")
    wins = (F.col("first.org_id") == F.col("org_id")) & (F.col("first.slug") == F.col("slug")) & (F.col("first.forge_id") == F.col("forge_id"))
    action = F.when(F.col("own_id").isNotNull(), "update").when(F.col("other_id").isNotNull() | ~wins, "conflict").otherwise("insert")
    of_sweep = (F.col("action") == "conflict") & F.col("other_id").isNull()
    now_in, was_in = (F.col("action") != "conflict") & (F.col("state") == "included"), F.coalesce(F.col("old_state") == "included", F.lit(False))
    rows = told.withColumn("action", action).select(
        "org_id", "slug", "action", F.coalesce("own_id", F.when(F.col("action") == "conflict", F.col("other_id"))).alias("repo_id"),
        F.when(of_sweep, F.col("first.forge_id")).alias("with_forge"), F.when(of_sweep, F.col("first.slug")).alias("with_slug"),
        (now_in & ~was_in).alias("enqueue"), ((F.col("action") == "update") & was_in & (F.col("state") != "included")).alias("remove"))
    still = rows.where("action = 'conflict'").select("org_id", "slug")
    gone = conflicts.select("org_id", "slug").distinct().join(still, ["org_id", "slug"], "left_anti")
    none, no = F.lit(None), F.lit(False)
    return rows.unionByName(gone.select("org_id", "slug", F.lit("resolved").alias("action"), none.cast("long").alias("repo_id"), none.cast("long").alias("with_forge"), none.cast("string").alias("with_slug"), no.alias("enqueue"), no.alias("remove")))


def reachable(repos: DataFrame, rules: DataFrame) -> DataFrame:
    """The repositories whose slug begins as a pattern does before its first wildcard: all that its rule can concern. Joined by equality, once for each length of such a beginning."""
    starts = rules.select(F.regexp_extract("pattern", r"^([^*?]*)", 1).alias("start")).distinct()
    lengths = sorted(r[0] for r in starts.select(F.length("start")).distinct().collect())  # of a rule list's patterns
    if not lengths:
        return repos.limit(0)
    each = repos.select("repo_id", F.explode(F.array(*[F.substring("slug", 1, n) for n in lengths])).alias("start"))
    return repos.join(each.join(F.broadcast(starts), "start", "left_semi").select("repo_id").distinct(), "repo_id", "left_semi")


def rule_delta(repos: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """repo_id, old_state, state of the repositories whose state another rule list changes. Only those that a rule which isn't in both lists can reach are judged again."""
    changed = before.exceptAll(after).unionByName(after.exceptAll(before))
    reached = reachable(repos, changed)
    old, new = (rule_precedence(reached, rules).select("repo_id", F.col("state").alias(name)) for rules, name in ((before, "old_state"), (after, "state")))
    return old.join(new, "repo_id").where("old_state <> state")

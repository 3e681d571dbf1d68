"""Lexical search over an index: normalised scores, merged pages, snippets, symbol look-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.query import AnyOf, Group, Leaf, Node, leaves, parse
from lattica.operators import postings as P
from lattica.operators.postings import Index
from lattica.schema import FUZZY_CAP, MAX_OFFSET, NODE_KINDS, SPREAD, TOP_K, UNADDRESSABLE, VerbError
from lattica.sources.scratch import scratch, settle


def search_docs(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Symbols (no content) and Files (content of bodies: node_id, content, empty if none) as documents; other kinds have none."""
    rows = nodes.where(F.col("kind").isin("Symbol", "File")).select("repo", F.col("id").alias("node_id"), "kind", "name", "path")
    joined = rows.join(bodies.select("node_id", F.col("content").alias("body")), "node_id", "left")
    return joined.select("repo", "node_id", "kind", "name", "path", F.when(F.col("kind") == "File", F.coalesce("body", F.lit(""))).otherwise("").alias("content"))


def indexed(docs: DataFrame | Index) -> Index:
    """An index as it is, of documents one written for the purpose."""
    return docs if isinstance(docs, Index) else P.build(docs, scratch(docs.sparkSession, "index"))


def bm25(index: DataFrame | Index, tree: Group, fields: dict[str, float] | None = None) -> DataFrame:
    """repo, node_id, kind, score of all documents that match."""
    index = indexed(index)
    return P.scores(index, tree, fields).join(index.docs.select("doc", "node_id", "kind"), "doc").select("repo", "node_id", "kind", "score")


def phrase_counts(index: Index, phrase: str, field: str) -> DataFrame:
    """repo, node_id, n: how often the tokens of a phrase stand side by side in a field."""
    found = P.phrase(index, field, Leaf(phrase).sought(field))
    return found.join(index.docs.select("doc", "node_id"), "doc").select("repo", "node_id", "n")


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    order = Window.partitionBy("repo").orderBy(F.desc("score"), "node_id")
    return scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def normalize(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """Scores over their repository's largest positive one, else 0; rounded before any ordering, so that ties break alike everywhere."""
    top = F.max(F.when((F.col("score") > 0) & (F.col("score") < float("inf")), F.col("score"))).over(Window.partitionBy("repo"))
    out = F.when(top.isNull(), 0.0).otherwise(F.col("score") / top)
    return scores.withColumn("score", F.round(out, digits) if digits is not None else out)


def merge_page(scores: DataFrame, offset: int, limit: int) -> DataFrame:
    """The rows of a page by score, repo and id, with their rank and has_more."""
    if offset + limit > MAX_OFFSET:
        raise VerbError("bad_request", "pages end at the thousandth hit")
    first = scores.orderBy(F.desc("score"), "repo", "node_id").limit(offset + limit + 1)  # a bounded top-k before the numbering
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "repo", "node_id")))
    return ranked.withColumn("has_more", F.max("rank").over(Window.partitionBy(F.lit(1))) > offset + limit).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def validate(query: str, kinds: Sequence[str] | None = None, repos: Sequence[str] | None = None) -> Group:
    """The tree of a request that may be made: a query that can be answered, known kinds, some repositories but not too many."""
    if kinds is not None and (not kinds or set(kinds) - set(NODE_KINDS)):
        raise VerbError("bad_request", "no kinds, or unknown ones")
    if repos is not None and not 1 <= len(repos) <= 1000:
        raise VerbError("bad_request", "between one and a thousand repositories")
    return parse(query)


def known(index: Index, repos: Sequence[str]) -> set[str]:
    """Which of at most some thousand repositories the index has."""
    return {r["repo"] for r in index.stats.where(F.col("repo").isin(list(repos))).select("repo").collect()}


def refuse_unknown(repos: Sequence[str], found: set[str]) -> None:
    if lost := set(repos) - found:
        raise VerbError("not_found", f"no repository {min(lost)}")


def kind_filter(docs: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    if kinds is None:
        return docs
    if not kinds or set(kinds) - set(NODE_KINDS):
        raise VerbError("bad_request", "no kinds, or unknown ones")
    return docs.where(F.col("kind").isin(list(kinds)))


def hits(index: Index, tree: Group, kinds: Sequence[str] | None = None) -> DataFrame:
    """repo, doc, score: the TOP_K of each repository, over its best score."""
    scored = P.scores(index, tree, None, kinds, TOP_K).withColumnRenamed("doc", "node_id")  # numbers are in the order of ids
    return normalize(top_k(scored.select("repo", "node_id", "score")), 6).withColumnRenamed("node_id", "doc")


def told(page: DataFrame, index: Index, tree: Group) -> DataFrame:
    """A page's rows (doc and others) with node_id, kind, name, path and a snippet; only its documents meet their texts."""
    words = sorted({w for x, excluded in leaves(tree) if not excluded for f in ("content", "content_whole") for w in _words(x, f)})
    page = settle(page, "page")
    at = [r["doc"] for r in page.select("doc").collect()]  # a page, so that the documents' files are read by number
    docs = index.docs.where(F.col("doc").isin(at)).drop("repo")
    return page.join(docs, "doc").withColumn("snippet", snippet(F.coalesce("content", F.lit("")), words)).drop("content", "doc")


def _words(x: Node, field: str) -> tuple[str, ...]:
    if isinstance(x, AnyOf):
        return x.words if x.field == field else ()
    return x.sought(field) if isinstance(x, Leaf) and x.field in (None, field) else ()


def search(docs: DataFrame | Index, query: str, kinds: Sequence[str] | None = None, repos: Sequence[str] | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """repo, node_id, score, rank, has_more, kind, name, path, snippet of a page; statistics are the repositories', whatever the kinds."""
    tree = validate(query, kinds, repos)
    index = indexed(docs)
    if repos is not None:
        refuse_unknown(repos, known(index, repos))
        index = index.of(repos)
    page = merge_page(hits(index, tree, kinds).withColumnRenamed("doc", "node_id"), offset, limit)
    return told(page.withColumnRenamed("node_id", "doc"), index, tree)


def snippet(text: Column, words: Sequence[str], width: int = 150) -> Column:
    """About width characters around the first word sought, words sought in <b>, all else escaped; empty where none occurs."""
    if not words:
        return F.lit("")
    seek = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(words) + ")"
    at = F.regexp_instr(text, F.lit(seek))
    cut = F.substring(text, F.greatest(F.lit(1), at - 40), F.lit(width))
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        cut = F.replace(cut, F.lit(c), F.lit(name))
    return F.when(at > 0, F.regexp_replace(cut, seek, "<b>$1</b>")).otherwise("")


def symbols_named(docs: DataFrame, names: DataFrame, fragment: Column | None = None) -> DataFrame:
    """Symbols of exactly a name (names: name): name, node_id, path, n, unaddressable. The guard counts before fragments of paths select."""
    rows = docs.where("kind = 'Symbol'").join(names, "name").select("name", "node_id", "path")
    rows = rows.withColumn("unaddressable", F.count(F.lit(1)).over(Window.partitionBy("name")) > UNADDRESSABLE)
    return rows if fragment is None else rows.where(F.col("path").contains(fragment))


def fuzzy(docs: DataFrame, names: DataFrame, fragment: Column | None = None) -> DataFrame:
    """name, outcome (no_such_symbol, exact, ambiguous or unaddressable), total, confidence, and up to 25 candidates by id."""
    found = symbols_named(docs, names, fragment)
    n = F.count("node_id").over(Window.partitionBy("name"))
    ranked = found.withColumn("total", n).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("node_id"))).where(F.col("r") <= FUZZY_CAP)
    by = ranked.groupBy("name").agg(F.first("total").alias("total"), F.first("unaddressable").alias("guard"), F.sort_array(F.collect_list("node_id")).alias("candidates"))
    out = names.join(by, "name", "left")
    outcome = F.when(F.col("total").isNull(), "no_such_symbol").when(F.col("guard"), "unaddressable").when(F.col("total") == 1, "exact").otherwise("ambiguous")
    return out.select("name", outcome.alias("outcome"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.when(outcome == "exact", 1.0).when(outcome == "ambiguous", SPREAD / F.col("total")).alias("confidence"), F.when(outcome == "ambiguous", F.col("candidates")).alias("candidates"))

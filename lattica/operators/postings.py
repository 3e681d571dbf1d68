"""An inverted index in blocks, and queries evaluated over it.

Documents are numbered in the order of (repo, node_id), so that a number stands for both and breaks ties as they do. A block holds the
postings of a field's token within a range of SEGMENT numbers: for each document its term frequency, the length norm of BM25, its kind and its
positions. Blocks are dealt to directories by a hash of (field, token), so that a query opens its terms' directories only. Beside its
postings a block has how many they are and, of more than BEST, its best impacts. These alone decide which segments are unpacked: not those in which a part of
the query that must match occurs nowhere, nor those whose best possible score is below what the k-th document of its repository has at least.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise
from operator import add, and_, or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.query import EXACT, FIELDS, AnyOf, Everything, Group, Leaf, Node, leaves
from lattica.functions.tokenize import parted, spaced
from lattica.schema import NODE_KINDS

K1, B = 1.2, 0.75
SEGMENT, BEST = 1024, 8
#: Directories of blocks; segments in a file of documents, whose blocks one task makes.
PARTS, FILE = 8, 4
DOC = ["doc", "repo", "node_id", "kind", "name", "path"]
BLOCK = "field string, token string, repo string, segment long, n long, best array<double>, docs array<struct<doc: long, tf: int, norm: double, kind_no: byte>>, positions array<array<int>>, whole_norm array<double>, whole_best array<double>"


class Index(NamedTuple):
    """docs: doc, repo, node_id, kind, name, path, content; stats: repo, n_docs, avg_<field>; blocks: part, field, token, repo, segment, n, best, docs, positions."""

    docs: DataFrame
    stats: DataFrame
    blocks: DataFrame
    parts: int
    key: str = ""  # its folder, which tells indexes apart

    def of(self, repos: Sequence[str]) -> Index:
        """Only some repositories."""
        mine = F.col("repo").isin(list(repos))
        return self._replace(docs=self.docs.where(mine), stats=self.stats.where(mine), blocks=self.blocks.where(mine))


def tokens(field: str) -> Column:
    """The tokens of a field, joined by spaces: its column's parts of identifiers, or (``_whole``) its whole words. Null if there are none."""
    text = F.coalesce(F.col(field.removesuffix("_whole")), F.lit(""))
    return F.nullif(spaced(text if field.endswith("_whole") else parted(text)), F.lit(""))


def value(field: str) -> Column:
    """The one token of a field of EXACT, or null."""
    return F.when(F.col("kind") == "Symbol", F.col("name")) if field == "raw_name" else F.col(field)


def part(field: Column, token: Column, parts: int) -> Column:
    """Both fields of one text lie together."""
    return F.pmod(F.xxhash64(F.regexp_replace(field, "_whole$", ""), token), F.lit(parts)).cast("int").alias("part")


@contextlib.contextmanager
def whole_files(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a scan gives each file to a task of its own."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(1 << 40))
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def build(docs: DataFrame, folder: str) -> Index:
    """Writes the index of documents (repo, node_id, kind, name, path, content) and reads it.

    Texts are shuffled once, by range, and written in files of whole segments; a task makes and writes the blocks of one file, of a segment at a
    time, so neither tokens nor postings are shuffled or sorted in bulk. A block that is alike in both fields of a text is written once. Texts are tokenised twice, first for the mean length of a field in a
    repository, which an impact needs, as they are smaller than their tokens.
    """
    spark = docs.sparkSession
    ordered = docs.select("repo", "node_id", "kind", "name", "path", "content").repartitionByRange("repo", "node_id").sortWithinPartitions("repo", "node_id")
    written = ordered.withColumn("doc", F.monotonically_increasing_id()).write.option("compression", "zstd")
    written.option("maxRecordsPerFile", FILE * SEGMENT).parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    # two fields of one column differ in the length only where identifiers have parts
    told = docs.select("repo", *[tokens(f).alias(f) for f in FIELDS])
    mean = [F.avg(F.coalesce(F.length(f) - F.length(F.replace(f, F.lit(" "), F.lit(""))) + 1, F.lit(0))).alias(f"avg_{f}") for f in FIELDS]
    told.groupBy("repo").agg(F.count(F.lit(1)).alias("n_docs"), *mean).write.parquet(f"{folder}/stats")
    stats = spark.read.parquet(f"{folder}/stats")
    means = stats.select("repo", F.array(*[F.col(f"avg_{f}") for f in FIELDS]).alias("means"))
    kind_no = F.coalesce(F.array_position(F.array(*map(F.lit, NODE_KINDS)), F.col("kind")), F.lit(0)).cast("byte")
    split = [*[tokens(f).alias(f) for f in FIELDS], *[value(f).alias(f) for f in EXACT]]
    placed = docs.join(F.broadcast(means), "repo").select("doc", F.shiftright("doc", SEGMENT.bit_length() - 1).alias("segment"), "repo", kind_no.alias("kind_no"), "means", *split)
    blocks = placed.mapInArrow(by_segment, BLOCK).withColumn("part", part(F.col("field"), F.col("token"), PARTS))
    dealt = blocks.sortWithinPartitions("part", "field", "token", "repo", "segment")
    with whole_files(spark):
        # tokens are sorted, so their common beginnings are left out, which the second version of the format does
        packed = dealt.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#token", "false")
        packed.partitionBy("part").parquet(f"{folder}/blocks")
    return load(spark, folder, PARTS)


def by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each segment of documents, which come in the order of their numbers."""
    held, at = [], None
    for batch in batches:
        segments = batch.column("segment").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(segments)) + 1), len(segments)]
        for a, b in pairwise(cuts):
            if b > a and segments[a] != at:
                if held:
                    yield blocks_of(pa.Table.from_batches(held).combine_chunks())
                held, at = [], segments[a]
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield blocks_of(pa.Table.from_batches(held).combine_chunks())


def blocks_of(docs: pa.Table) -> pa.RecordBatch:
    """The blocks of a segment's documents: its tokens' numbers are sorted by (field, repo, token), and stay in the order of documents and places."""
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    names, n_docs = (*FIELDS, *EXACT), docs.num_rows
    lists = [whole(pc.split_pattern(docs[f], " ")) for f in FIELDS]
    values = [x.flatten() for x in lists] + [whole(docs[f].drop_null()) for f in EXACT]
    lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists] + [pc.is_valid(whole(docs[f])).to_numpy(zero_copy_only=False).astype(np.int32) for f in EXACT]
    lengths = np.stack(lengths).astype(np.int64)  # a row a field
    found = pa.concat_arrays(values).dictionary_encode()
    repos = whole(docs["repo"]).dictionary_encode()
    n_repos, n_tokens = len(repos.dictionary), max(1, len(found.dictionary))
    row = np.repeat(np.tile(np.arange(n_docs), len(names)), lengths.ravel())  # of each token
    starts = np.cumsum(lengths.ravel()) - lengths.ravel()
    pos = (np.arange(len(row)) - np.repeat(starts, lengths.ravel())).astype(np.int32)
    field_no = np.repeat(np.arange(len(names)), lengths.sum(axis=1))
    key = (field_no * n_repos + repos.indices.to_numpy()[row]) * n_tokens + found.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, row, pos = key[order], row[order], pos[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    post_at = np.flatnonzero(new | np.append(True, row[1:] != row[:-1])[: len(key)])  # the first token of each posting
    block_at = np.flatnonzero(new[post_at])  # the first posting of each block
    n = np.diff(np.append(block_at, len(post_at)))
    tf, of, kinds = np.diff(np.append(post_at, len(key))), row[post_at], whole(docs["kind_no"]).to_numpy()
    block_field, rest = np.divmod(key[post_at][block_at], n_repos * n_tokens)
    mean = np.ones((len(names), n_docs))
    mean[: len(FIELDS)] = whole(docs["means"]).flatten().to_numpy().reshape(n_docs, len(FIELDS)).T
    share = np.divide(lengths, mean, out=np.ones_like(mean), where=mean > 0)
    share[len(FIELDS) :] = 1.0
    norm = (K1 * (1 - B + B * share))[np.repeat(block_field, n), of]
    impact = tf * (K1 + 1) / (tf + norm)
    block = np.repeat(np.arange(len(n)), n)
    top = np.lexsort((-impact, block))[(np.arange(len(block)) - block_at[block] < BEST) & (n[block] > BEST)]
    twins, others = [], []  # the blocks of a field that the text's other field has alike: its documents, frequencies and places
    for f in range(0, len(FIELDS), 2):
        ours, theirs = np.flatnonzero(block_field == f), np.flatnonzero(block_field == f + 1)
        _, x, y = np.intersect1d(rest[ours], rest[theirs], assume_unique=True, return_indices=True)
        x, y = alike(ours[x], theirs[y], block_at, n, of, tf)
        size = np.add.reduceat(tf, block_at) if len(n) else n
        x, y = alike(x, y, post_at[block_at], size, pos)
        twins, others = [*twins, x], [*others, y]
    twins, others = np.concatenate(twins), np.concatenate(others)
    twinned, kept = np.isin(np.arange(len(n)), twins), ~np.isin(np.arange(len(n)), others)
    long_twins = twinned & (n > BEST)
    other_best = np.searchsorted(block[top], others[n[others] > BEST])
    listed = lambda counts, x, none=None: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), x, mask=none)
    posts = {"doc": whole(docs["doc"]).to_numpy()[of], "tf": tf.astype(np.int32), "norm": norm, "kind_no": kinds[of]}
    made = pa.RecordBatch.from_pydict({
        "field": pa.array(names).take(pa.array(block_field)), "token": found.dictionary.take(pa.array(rest % n_tokens)), "repo": repos.dictionary.take(pa.array(rest // n_tokens)),
        "segment": np.full(len(n), docs["segment"][0].as_py(), np.int64), "n": n.astype(np.int64), "best": listed(np.where(n > BEST, BEST, 0), pa.array(impact[top]), pa.array(n <= BEST)),
        "docs": listed(n, pa.StructArray.from_arrays([pa.array(x) for x in posts.values()], list(posts))), "positions": listed(n, listed(tf, pa.array(pos))),
        "whole_norm": listed(np.where(twinned, n, 0), pa.array(norm[spans(block_at[others], n[others])]), pa.array(~twinned)),
        "whole_best": listed(np.where(long_twins, BEST, 0), pa.array(impact[top][spans(other_best, np.full(len(other_best), BEST))]), pa.array(~long_twins)),
    })
    return made.filter(pa.array(kept))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of spans, one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def alike(x: np.ndarray, y: np.ndarray, starts: np.ndarray, counts: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of pairs of blocks whose spans have the same values."""
    same = counts[x] == counts[y]
    x, y = x[same], y[same]
    if not len(x):
        return x, y
    a, b = spans(starts[x], counts[x]), spans(starts[y], counts[y])
    equal = np.logical_and.reduce([v[a] == v[b] for v in values])
    same = np.logical_and.reduceat(equal, np.cumsum(counts[x]) - counts[x])
    return x[same], y[same]


def load(spark, folder: str, parts: int) -> Index:
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Index(read("docs"), read("stats"), unfolded(read("blocks")), parts, folder)


def unfolded(blocks: DataFrame) -> DataFrame:
    """A row a block of written ones, of which one may stand for both fields of a text."""
    own = F.struct("field", "best", "docs")
    docs = F.zip_with("docs", "whole_norm", lambda d, norm: d.withField("norm", norm))
    whole = F.struct(F.concat("field", F.lit("_whole")).alias("field"), F.col("whole_best").alias("best"), docs.alias("docs"))
    each = F.explode(F.when(F.col("whole_norm").isNull(), F.array(own)).otherwise(F.array(own, whole)))
    return blocks.select("part", "token", "repo", "segment", "n", "positions", each.alias("x")).select("part", "x.field", "token", "repo", "segment", "n", "x.best", "x.docs", "positions")


class Term(NamedTuple):
    field: str
    token: str


def opened(index: Index, terms: Sequence[Term]) -> DataFrame:
    """The blocks of terms, with i, the term's number; only the directories that can have them are read. Short blocks tell their best by their postings."""
    joined = lambda f, t: F.concat_ws("\0", f, t)
    number = F.create_map(*[c for i, t in enumerate(terms) for c in (joined(*map(F.lit, t)), F.lit(i))])
    hit = index.docs.sparkSession.range(1).select(F.array(*[part(*map(F.lit, t), index.parts) for t in terms])).first()[0]
    blocks = index.blocks.where(F.col("part").isin(sorted(set(hit))) & F.col("field").isin(sorted({t.field for t in terms})) & F.col("token").isin(sorted({t.token for t in terms})))
    told = blocks.withColumn("i", F.try_element_at(number, joined(F.col("field"), F.col("token")))).where("i IS NOT NULL").drop("field", "token")
    impacts = F.transform("docs", lambda d: d["tf"] * (K1 + 1) / (d["tf"] + d["norm"]))
    return told.withColumn("best", F.coalesce("best", F.sort_array(impacts, asc=False)))


def phrase(index: Index, field: str, words: Sequence[str]) -> DataFrame:
    """repo, doc, n: the documents in whose field the words stand side by side, and how often; lists of one segment meet, block by block."""
    terms = list(dict.fromkeys(Term(field, w) for w in words))
    blocks = opened(index, terms).select("i", "repo", "segment", F.col("docs.doc").alias("doc"), "positions")
    pick = lambda i: F.max(F.when(F.col("i") == i, F.struct("doc", "positions"))).alias(f"list_{i}")
    by = blocks.groupBy("repo", "segment").agg(*[pick(i) for i in range(len(terms))])
    for i in range(len(terms)):
        by = by.where(F.col(f"list_{i}").isNotNull())
    common = reduce(F.array_intersect, [F.col(f"list_{i}.doc") for i in range(len(terms))])
    of = lambda i, doc: F.get(F.col(f"list_{i}.positions"), (F.array_position(F.col(f"list_{i}.doc"), doc) - 1).cast("int"))
    at = [terms.index(Term(field, w)) for w in words]
    rows = by.withColumn("common", common).withColumn("x", F.explode("common"))
    return rows.select("repo", F.col("x").alias("doc"), together([of(i, F.col("x")) for i in at]).cast("long").alias("n")).where("n > 0")


def sought(leaf: Node, fields: dict[str, float]) -> list[tuple[str, tuple[str, ...], float]]:
    """The fields of a leaf, its tokens there and the boost; fields without tokens are left out."""
    if isinstance(leaf, AnyOf):
        return [(leaf.field, leaf.words, leaf.boost)]
    if isinstance(leaf, Everything):
        return []
    chosen = {leaf.field: fields.get(leaf.field, 1.0)} if leaf.field else fields
    return [(f, t, boost * leaf.boost) for f, boost in chosen.items() if (t := leaf.sought(f))]


def possible(node: Node, bound: dict[Node, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Whether a segment may hold a match of a node, and the largest score that one can have there; bound has both for each leaf."""
    if not isinstance(node, Group):
        return bound[node]
    told = [(occur, *possible(x, bound)) for occur, x in node.clauses if occur != "must_not"]
    must = [may for occur, may, _ in told if occur == "must"]
    may = reduce(and_, must) if must else reduce(or_, [m for _, m, _ in told], F.lit(False))
    return may, node.boost * reduce(add, [F.when(m, s).otherwise(0.0) for _, m, s in told], F.lit(0.0))


def matched(node: Node, of: dict[Node, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Whether a document matches a node, and its score if it does: all that must, or else something that should, and nothing that must not."""
    if not isinstance(node, Group):
        return of[node]
    told = [(occur, *matched(x, of)) for occur, x in node.clauses]
    must, not_ = ([m for occur, m, _ in told if occur == kind] for kind in ("must", "must_not"))
    held = reduce(and_, must) if must else reduce(or_, [m for occur, m, _ in told if occur == "should"], F.lit(False))
    for m in not_:
        held = held & ~m
    return held, node.boost * reduce(add, [F.when(m, s).otherwise(0.0) for occur, m, s in told if occur != "must_not"], F.lit(0.0))


def single(tree: Node) -> bool:
    """Whether any document that holds a word matches and has that word's points at least: nothing must or must not, no sets, and no group counts for less."""
    return isinstance(tree, Leaf) or isinstance(tree, Group) and tree.boost >= 1 and all(occur == "should" and single(x) for occur, x in tree.clauses)


def scores(index: Index, tree: Group, fields: dict[str, float] | None = None, kinds: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """doc, repo, score of the documents that match; with most, of each repository at least the first most by (score, doc).

    BM25 with exact lengths per field and repository, boosts multiplied in; a phrase has the sum of its words' weights and the frequency of
    the phrase; a set and ``*`` have one point. Statistics are the repository's, whatever the kinds.
    """
    fields = fields or FIELDS
    nodes = list(dict.fromkeys(x for x, _ in leaves(tree)))
    asked = {x: sought(x, fields) for x in nodes}
    if not any(asked.values()) and Everything not in map(type, nodes):
        return index.docs.select("doc", "repo", F.lit(0.0).alias("score")).where(F.lit(False))
    terms = list(dict.fromkeys(Term(f, t) for found in asked.values() for f, words, _ in found for t in words))
    number = {t: i for i, t in enumerate(terms)}
    blocks = opened(index, terms) if terms else index.blocks.where(F.lit(False)).withColumn("i", F.lit(0))
    place = blocks.select("i", "repo", "segment", "n", "best")  # a row a block, without its postings
    if terms:
        heads = place.groupBy("repo").agg(*[F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0)).alias(f"df_{i}") for i in number.values()])
        heads = index.stats.select("repo", "n_docs").join(heads, "repo")
        idf = [F.log(1 + (F.col("n_docs") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)).alias(f"idf_{i}") for i in number.values()]
        weights = heads.select("repo", *idf)  # a row a repository
    else:
        weights = index.stats.select("repo")
    phrases = {(f, words) for x, found in asked.items() if isinstance(x, Leaf) for f, words, _ in found if len(words) > 1}
    need = sorted({number[Term(f, t)] for f, words in phrases for t in words})
    weight = lambda f, words: reduce(add, [F.col(f"idf_{number[Term(f, t)]}") for t in words])

    if terms and Everything not in map(type, nodes):
        chosen = _segments(place, weights, tree, asked, number, weight, kinds, most)
        blocks = blocks.join(chosen, ["repo", "segment"], "left_semi")
    pos = F.when(F.col("i").isin(need), F.col("positions")) if need else F.lit(None).cast("array<array<int>>")
    each = F.transform("docs", lambda d, k: F.struct(d["doc"].alias("doc"), d["tf"].alias("tf"), d["norm"].alias("norm"), d["kind_no"].alias("kind_no"), F.get("pos", k).alias("pos")))
    rows = blocks.withColumn("pos", pos).select("i", "repo", F.explode(each).alias("x")).select("i", "repo", "x.*")
    if kinds is not None:
        rows = rows.where(F.col("kind_no").isin([NODE_KINDS.index(k) + 1 for k in kinds]))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    by = rows.groupBy("repo", "doc").agg(F.lit(0).alias("any"), *[pick(i, c).alias(f"{c}_{i}") for i in number.values() for c in ("tf", "norm")], *[pick(i, "pos").alias(f"pos_{i}") for i in need])
    if Everything in map(type, nodes):
        base = index.docs if kinds is None else index.docs.where(F.col("kind").isin(list(kinds)))
        by = base.select("repo", "doc").join(by, ["repo", "doc"], "left")
    by = by.join(weights, "repo", "left")

    def impact(tf: Column, i: int) -> Column:
        return tf * (K1 + 1) / (tf + F.col(f"norm_{i}"))

    def one(node: Node) -> tuple[Column, Column]:
        if isinstance(node, Everything):
            return F.lit(True), F.lit(node.boost)
        if isinstance(node, AnyOf):
            return reduce(or_, [F.col(f"tf_{number[Term(node.field, t)]}").isNotNull() for t in node.words], F.lit(False)), F.lit(node.boost)
        held, total = F.lit(False), F.lit(0.0)
        for f, words, boost in asked[node]:
            at = [number[Term(f, t)] for t in words]
            tf = F.col(f"tf_{at[0]}") if len(at) == 1 else together([F.col(f"pos_{i}") for i in at])
            there = F.coalesce(tf > 0, F.lit(False))
            held, total = held | there, total + F.when(there, boost * weight(f, words) * impact(tf, at[0])).otherwise(0.0)
        return held, total

    held, score = matched(tree, {x: one(x) for x in nodes})
    return by.where(held).select("doc", "repo", score.alias("score"))


def together(positions: list[Column]) -> Column:
    """At how many places the words of a phrase stand side by side: their sorted positions, each moved to the first word's, intersected."""
    def moved(p: Column, by: int) -> Column:
        return F.transform(p, lambda x: x - F.lit(by)) if by else p

    return F.size(reduce(F.array_intersect, [moved(p, by) for by, p in enumerate(positions)]))


def _segments(place: DataFrame, weights: DataFrame, tree: Group, asked: dict, number: dict, weight, kinds, most: int | None) -> DataFrame:
    """repo, segment of those that may hold a document that is wanted.

    The k-th score of a repository is at least the k-th largest single impact, weighted, that its blocks tell of, where any document that
    holds a term matches: each of the BEST impacts of a block belongs to another document. So the blocks of the one term that promises most are taken.
    """
    best = [F.max(F.when(F.col("i") == i, F.get("best", F.lit(0)))).alias(f"best_{i}") for i in number.values()]
    by = place.groupBy("repo", "segment").agg(*best).join(weights, "repo")
    bound = {}
    for x, found in asked.items():
        if isinstance(x, AnyOf):
            bound[x] = reduce(or_, [F.col(f"best_{number[Term(x.field, t)]}").isNotNull() for t in x.words], F.lit(False)), F.lit(x.boost)
            continue
        may, score = F.lit(False), F.lit(0.0)
        for f, words, boost in found:
            there = reduce(and_, [F.col(f"best_{number[Term(f, t)]}").isNotNull() for t in words])
            # of a phrase no impact is known; none is K1 + 1 or more
            top = F.col(f"best_{number[Term(f, words[0])]}") if len(words) == 1 else F.lit(K1 + 1)
            may, score = may | there, score + F.when(there, boost * weight(f, words) * top).otherwise(0.0)
        bound[x] = may, score
    may, score = possible(tree, bound)
    rows = by.where(may).select("repo", "segment", score.alias("bound"))
    if most is None or kinds is not None or not single(tree):
        return rows.select("repo", "segment")
    lone = [(number[Term(f, words[0])], boost) for x, found in asked.items() for f, words, boost in found if len(words) == 1]
    if not lone:
        return rows.select("repo", "segment")
    each = place.join(weights, "repo").where(F.col("i").isin([i for i, _ in lone]))
    boosts = reduce(lambda c, x: c.when(F.col("i") == x[0], F.lit(x[1]) * F.col(f"idf_{x[0]}")), lone, F.when(F.lit(False), 0.0))
    told = each.select("repo", "i", F.explode("best").alias("impact"), boosts.alias("w")).select("repo", "i", (F.col("impact") * F.col("w")).alias("score"))
    order = Window.partitionBy("repo", "i").orderBy(F.desc("score"))
    kth = told.withColumn("r", F.row_number().over(order)).where(F.col("r") == most).groupBy("repo").agg(F.max("score").alias("least"))
    return rows.join(kth, "repo", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9)).select("repo", "segment")

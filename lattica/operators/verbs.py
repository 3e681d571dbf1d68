"""The closed set of operations on published graphs, by external ids, a page at a time."""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import cursor as C
from lattica.functions.query import Group
from lattica.operators import graph as G
from lattica.operators import history as H
from lattica.operators import postings as P
from lattica.operators import search as S
from lattica.schema import MAX_LIMIT, MAX_OFFSET, VerbError
from lattica.sources.files import Store
from lattica.sources.scratch import settle

_ID = re.compile(r"(file|sym|pkg|commit|contributor):([^/:]+:[0-9]+/[^:]*|[^:]+):(.+)", re.S)


class Catalog:
    """Which graphs there are: of each repository (by its qualifier) the revision in force, and older ones as long as they are kept."""

    def __init__(self) -> None:
        self.graphs: dict[tuple[str, str], G.Graph] = {}
        self.indexes: dict[tuple[str, str], P.Index] = {}
        self.current: dict[str, str] = {}

    def put(self, qualifier: str, revision: str, graph: G.Graph | None, index: P.Index | None = None) -> None:
        """An index may be of several repositories, and be put for each; in it a repository goes by its qualifier."""
        if graph is not None:
            self.graphs[qualifier, revision] = graph
        if index is not None:
            self.indexes[qualifier, revision] = index
        self.current[qualifier] = revision

    @classmethod
    def of(cls, store: Store, qualifiers: dict[int, str]) -> Catalog:
        """What the pointers of a store have in force, of the repositories that have a qualifier."""
        out = cls()
        for r in store.pointers().where(F.col("repo").isin(list(qualifiers))).collect():  # a row a repository that is served
            at = r["repo"], r["revision"]
            nodes, edges, calls, index = store.read(*at, "nodes"), store.rows(*at), store.calls(*at), store.index(*at)
            own = index._replace(**{x: getattr(index, x).withColumn("repo", F.lit(qualifiers[r["repo"]])) for x in ("docs", "stats", "blocks")})
            out.put(qualifiers[r["repo"]], r["revision"], G.plain(nodes, edges, calls), own)
        return out

    def searched(self, repos: Sequence[str] | None, revisions: dict[str, str] | None) -> tuple[dict[str, str], list[P.Index]]:
        """The revisions that a search reads, those of its cursor or else those in force, and their indexes, each once, of these repositories only."""
        if revisions is None:
            if lost := set(repos or ()) - set(self.current):
                raise VerbError("not_found", f"no repository {min(lost)}")
            revisions = {q: r for q, r in self.current.items() if q in repos} if repos else {q: r for q, r in self.current.items() if (q, r) in self.indexes}
        if any(at not in self.indexes for at in revisions.items()):
            raise VerbError("gone", "a revision that the search reads is no longer kept")
        by: dict[int, tuple[P.Index, list[str]]] = {}
        for at in revisions.items():
            by.setdefault(id(self.indexes[at]), (self.indexes[at], []))[1].append(at[0])
        return revisions, [index.of(mine) for index, mine in by.values()]

    def drop(self, qualifier: str, revision: str) -> None:
        self.graphs.pop((qualifier, revision), None)
        self.indexes.pop((qualifier, revision), None)
        if self.current.get(qualifier) == revision:
            del self.current[qualifier]

    def resolve(self, node_id: str, revision: str | None = None) -> tuple[str, str, G.Graph, str]:
        """qualifier, revision, graph and local id of an external id. An unknown repository is not found; a revision that a cursor names and that is no longer kept is gone."""
        if not (m := _ID.fullmatch(node_id)):
            raise VerbError("bad_request", "no external id")
        kind, qualifier, local = m.groups()
        if qualifier not in self.current:
            raise VerbError("gone" if revision else "not_found", f"no repository {qualifier}")
        chosen = revision or self.current[qualifier]
        if (qualifier, chosen) not in self.graphs:
            raise VerbError("gone", "the revision that the cursor reads is no longer kept")
        return qualifier, chosen, self.graphs[qualifier, chosen], f"{kind}:{local}"


class Page(NamedTuple):
    rows: DataFrame
    next: str | None


class Engine:
    """Operations over a catalog; key signs the cursors."""

    def __init__(self, catalog: Catalog, key: bytes) -> None:
        self.catalog = catalog
        self.codecs = {verb: C.Codec(key, verb) for verb in ("neighbors", "history", "search")}
        self.found: OrderedDict[str, DataFrame] = OrderedDict()

    def _at(self, verb: str, node_id: str, request: dict, cursor: str | None) -> tuple[dict, str, str, G.Graph, str]:
        told = self.codecs[verb].decode(cursor) if cursor else {}
        if told:
            C.agree(told, request)
        return told, *self.catalog.resolve(node_id, told.get("revision"))

    def _next(self, verb: str, request: dict, revision: str, after: list) -> str:
        return self.codecs[verb].encode({"request": request, "revision": revision, "after": after})

    def node(self, node_id: str) -> DataFrame:
        """The node and, a row each, the directions and kinds of its edges."""
        _, _, graph, local = self.catalog.resolve(node_id)
        one = G.node(graph, local)
        if not one.limit(1).count():
            raise VerbError("not_found", f"no node {node_id}")
        return one.select("id", F.col("kind").alias("node_kind"), "name", "path").join(G.edge_summary(graph, one), "id", "left")

    def neighbors(self, node_id: str, direction: str = "both", kinds: Sequence[str] | None = None, depth: int = 1, limit: int = 100, cursor: str | None = None) -> Page:
        """A page in the order of (depth, external id), read at the revision at which the first page was."""
        G.validate(direction, kinds, depth, limit)
        request = C.shape(node_id, direction, kinds, depth)
        told, repo, revision, graph, local = self._at("neighbors", node_id, request, cursor)
        after = tuple(told["after"]) if told else None
        rows = G.neighbors(graph, local, direction, kinds, depth, limit, after, repo)
        last = rows.orderBy(F.desc("rank")).select("depth", "ext", "more").first()
        return Page(rows, self._next("neighbors", request, revision, [last["depth"], last["ext"]]) if last and last["more"] else None)

    def history(self, node_id: str, limit: int = 50, since: int | None = None, cursor: str | None = None) -> Page:
        """A page of the commits that touch a file, newest first."""
        if not 1 <= limit <= MAX_LIMIT:
            raise VerbError("bad_request", "limit out of range")
        request = C.shape(node_id, since=since)
        told, _, revision, graph, local = self._at("history", node_id, request, cursor)
        rows = H.history(graph, local, limit, since, tuple(told["after"]) if told else None)
        ends = rows.orderBy(F.desc("committed_at"), "id").select("committed_at", "id").collect()  # a page
        page = rows.orderBy(F.desc("committed_at"), "id").limit(limit)
        return Page(page, self._next("history", request, revision, list(ends[limit - 1])) if len(ends) > limit else None)

    def search(self, query: str, kinds: Sequence[str] | None = None, repos: Sequence[str] | None = None, limit: int = 20, cursor: str | None = None) -> Page:
        """A page of hits: repo, node_id, score, rank, kind, name, path, snippet, by (score, repo, id).

        All pages read the revisions that the first one did, whatever is published meanwhile. What a search finds, at most TOP_K a repository, is
        written once for its pages; should the written hits have gone they are found again, and are the same. Pages end at the MAX_OFFSETth hit.
        """
        if not 1 <= limit <= MAX_LIMIT:
            raise VerbError("bad_request", "limit out of range")
        tree, request = S.validate(query, kinds, repos), C.searched(query, kinds, repos)
        told = self.codecs["search"].decode(cursor) if cursor else {}
        if told:
            C.agree(told, request)
        revisions, indexes = self.catalog.searched(repos, told.get("revisions"))
        hits = self._hits(json.dumps([request, revisions], sort_keys=True), indexes, tree, kinds)
        score, repo, doc, rank = told["after"] if told else (None, "", -1, 0)
        if told:
            hits = hits.where((F.col("score") < score) | ((F.col("score") == score) & ((F.col("repo") > repo) | ((F.col("repo") == repo) & (F.col("doc") > doc)))))
        limit = min(limit, MAX_OFFSET - rank)
        first = hits.orderBy(F.desc("score"), "repo", "doc").limit(limit + 1).collect()  # a page
        page, more = first[:limit], len(first) > limit and rank + limit < MAX_OFFSET
        spark = indexes[0].docs.sparkSession
        parts = []
        for index in indexes:
            rows = [(r["repo"], r["doc"], r["score"], rank + i, k) for i, r in enumerate(page, 1) for k in [index.key] if r["key"] == k]
            if rows or not parts and index is indexes[-1]:
                parts.append(S.told(spark.createDataFrame(rows, "repo string, doc long, score double, rank int, key string").drop("key"), index, tree))
        last = page[-1] if page else None
        after = [last["score"], last["repo"], last["doc"], rank + len(page)] if last else None
        return Page(reduce(DataFrame.unionByName, parts), self.codecs["search"].encode({"request": request, "revisions": revisions, "after": after}) if more else None)

    def _hits(self, key: str, indexes: Sequence[P.Index], tree: Group, kinds: Sequence[str] | None) -> DataFrame:
        if key not in self.found:
            each = [S.hits(index, tree, kinds).select("repo", "doc", "score", F.lit(index.key).alias("key")) for index in indexes]
            self.found[key] = settle(reduce(DataFrame.unionByName, each), "hits")
            while len(self.found) > 16:
                self.found.popitem(last=False)
        self.found.move_to_end(key)
        return self.found[key]

"""Bounded reads of the graph: a node with its edge summary, and breadth-first neighbourhood pages.

A graph is read in two layouts of its edges, by source and by target, and by the nodes' ids. Written ones are dealt to
directories by a hash of that key, and sorted by it within, so that a read of a few nodes opens only their directories;
the files of a node of very many edges are split by the edges' order.

A graph that isn't written is read by scans: its frames are filtered by the nodes asked for, which are few, so that no edge is shuffled. One
question costs less so than writing the layouts; many cost less with them.

CALLS stay factorised as they were resolved: references by caller and by class, members of classes by class and by symbol. A read expands
those of its nodes, up to a cap where it has one; the graph grows with the references, not with what they may mean. Beside the edges a graph
has their number by node, kind and side, so that a level knows which nodes its budget reaches before any edge is read, and TOUCHES by file and
time with what a page of history shows of their commits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import ids
from lattica.operators.resolve import References
from lattica.schema import BUDGET, DIRECTIONS, EDGE_KINDS, MAX_DEPTH, MAX_LIMIT, NODE_CAP, PAGE_EDGE_CAP, VerbError
from lattica.sources.scratch import settle

EDGE = ["edge_seq", "src", "dst", "kind", "provenance", "confidence", "location"]
NODE = ["id", "kind", "name", "path", "committed_at"]
MAX_PARTS, ROWS_A_PART = 4096, 2_000_000


#: What a history shows of a commit that touches a file (near).
TOUCH = ["near", "committed_at", "id", "name"]


class Calls(NamedTuple):
    """Factorised CALLS: by_caller and by_class: near (the caller), cls, n, confidence, location; of_class and of_symbol: cls, near (a member)."""

    by_caller: DataFrame
    by_class: DataFrame
    of_class: DataFrame
    of_symbol: DataFrame


class Graph(NamedTuple):
    """nodes; out and back: a row per edge with near (its source or its target), far, out (whether near is the source) and the edge.

    parts: into how many directories they are dealt; None for frames that are not written. degrees: id, kind, outs, ins, loops. A
    graph without calls has its CALLS among its edges.
    """

    nodes: DataFrame
    out: DataFrame
    back: DataFrame
    parts: int | None = None
    calls: Calls | None = None
    degrees: DataFrame | None = None
    touches: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        """All edges, factorised ones expanded."""
        found = self.out.select(*EDGE)
        if self.calls is None:
            return found
        pairs = self.calls.by_caller.select(F.col("near").alias("src"), "cls", "confidence", "location").join(self.calls.of_class.select("cls", F.col("near").alias("dst")), "cls")
        return found.unionByName(_call(pairs, "src").select(*EDGE))

    def of_kinds(self, kinds: Sequence[str] | None) -> Graph:
        if kinds is None:
            return self
        chosen = F.col("kind").isin(list(kinds))
        return self._replace(out=self.out.where(chosen), back=self.back.where(chosen), calls=self.calls if "CALLS" in kinds else None, degrees=self.degrees.where(chosen) if self.degrees is not None else None)

    def at(self, frame: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
        """frame without the directories in which nothing of wanted (column key) can be; at most MAX_PARTS numbers come to the driver."""
        if self.parts is None:
            return frame.drop("part")
        hit = [r[0] for r in wanted.select(part(F.col(key), self.parts)).distinct().collect()]
        return (frame if len(hit) == self.parts else frame.where(F.col("part").isin(hit))).drop("part")

    def few(self, rows: DataFrame, what: str) -> DataFrame:
        """rows that frames of a graph that isn't written are filtered by: on disk their size is known, so that small ones are broadcast."""
        return rows if self.parts is not None else settle(rows, what)


def _call(pairs: DataFrame, near: str) -> DataFrame:
    """CALLS with near, far, out and the edge of pairs src, dst, confidence, location; near is src or dst."""
    edge = pairs.select("src", "dst", F.lit("CALLS").alias("kind"), F.lit("syntactic").alias("provenance"), "confidence", "location")
    return _sided(edge.withColumn("edge_seq", sequence()), near, "dst" if near == "src" else "src")


def sequence(src: str = "src", dst: str = "dst") -> Column:
    """The edge_seq of edges that have no order of their own."""
    return F.concat_ws("\x01", "kind", src, dst, F.coalesce("location", F.lit("")))


def part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")


def _sided(edges: DataFrame, near: str, far: str) -> DataFrame:
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far"), F.lit(near == "src").alias("out"), *EDGE)


def plain(nodes: DataFrame, edges: DataFrame, calls: References | None = None) -> Graph:
    """A graph of frames as they are; calls: CALLS that aren't among edges."""
    if calls is None:
        return Graph(nodes, _sided(edges, "src", "dst"), _sided(edges, "dst", "src"))
    refs, members = calls.refs.select(F.col("caller_id").alias("near"), "cls", "n", "confidence", "location"), calls.members.select("cls", F.col("symbol_id").alias("near"))
    return Graph(nodes, _sided(edges, "src", "dst"), _sided(edges, "dst", "src"), calls=Calls(refs, refs, members, members))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "kind").agg(*[F.sum(c).cast("long").alias(c) for c in ("outs", "ins", "loops")])


def _call_degrees(mine: DataFrame, held: DataFrame, named: DataFrame) -> DataFrame:
    """Rows id, kind, outs, ins, loops of CALLS: of references (id, cls, n), of members (id, cls) and of all references to their classes (cls)."""
    none, kind = F.lit(0).cast("long"), F.lit("CALLS").alias("kind")
    outs = mine.groupBy("id").agg(F.sum("n").alias("outs")).select("id", kind, "outs", none.alias("ins"), none.alias("loops"))
    named = named.groupBy("cls").agg(F.count(F.lit(1)).alias("ins"))
    ins = held.join(named, "cls").groupBy("id").agg(F.sum("ins").alias("ins")).select("id", kind, none.alias("outs"), "ins", none.alias("loops"))
    loops = mine.join(held, ["id", "cls"]).groupBy("id").agg(F.count(F.lit(1)).alias("loops")).select("id", kind, none.alias("outs"), none.alias("ins"), "loops")
    return outs.unionByName(ins).unionByName(loops)


def _degrees(out: DataFrame, back: DataFrame, calls: References | None) -> DataFrame:
    """id, kind, outs, ins, loops: how many edges a node has on either side, and how many of these on both. Of layouts, in which a node's edges lie together."""
    side = lambda rows, outs, ins: rows.select(F.col("near").alias("id"), "kind", F.lit(outs).alias("outs"), F.lit(ins).alias("ins"), ((F.col("near") == F.col("far")).cast("long") if outs else F.lit(0)).alias("loops"))
    rows = side(out, 1, 0).unionByName(side(back, 0, 1))
    if calls is not None:
        refs = calls.refs.select(F.col("caller_id").alias("id"), "cls", "n")
        rows = rows.unionByName(_call_degrees(refs, calls.members.select(F.col("symbol_id").alias("id"), "cls"), refs))
    return _summed(rows)


def _packed(edges: DataFrame, near: str, far: str) -> DataFrame:
    """A layout as it is written: what it has of _sided that doesn't follow from the rest; an edge_seq only where it isn't that of sequence()."""
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far"), "kind", "provenance", "confidence", "location", F.when(F.col("edge_seq") != sequence(), F.col("edge_seq")).alias("own_seq"))


def _unpacked(rows: DataFrame, near: str) -> DataFrame:
    ends = ("near", "far") if near == "src" else ("far", "near")
    seq = F.coalesce("own_seq", sequence(*ends))
    full = {"edge_seq": seq, "src": F.col(ends[0]), "dst": F.col(ends[1])}
    return rows.select("near", "far", F.lit(near == "src").alias("out"), *[full[c].alias(c) if c in full else c for c in EDGE], *[c for c in rows.columns if c == "part"])


def write(nodes: DataFrame, edges: DataFrame, folder: str, parts: int | None = None, calls: References | None = None) -> Graph:
    """Writes a graph and reads it; the number of directories follows the number of edges and references. calls: CALLS that aren't among edges."""
    spark, packed = nodes.sparkSession, settle(_packed(edges, "src", "dst"), "edges")
    edges = _unpacked(packed, "src")
    if calls is not None:
        calls = References(settle(calls.refs.select("caller_id", "cls", "n", "confidence", "location"), "references"), settle(calls.members, "members"))
    size = packed.count() + (calls.refs.count() if calls is not None else 0)
    parts = parts or min(MAX_PARTS, max(8, size // ROWS_A_PART))
    commits = nodes.where("kind = 'Commit'").select("id", "name", "committed_at")
    touches = edges.where("kind = 'TOUCHES'").select(F.col("dst").alias("near"), F.col("src").alias("id")).join(commits, "id").select(*TOUCH)
    tables = {
        "nodes": (nodes.select(*NODE), "id", ["id"]), "touches": (touches, "near", ["near", F.desc("committed_at"), "id"]),
        "out": (packed, "near", ["near", F.coalesce("own_seq", sequence("near", "far"))]), "back": (_packed(edges, "dst", "src"), "near", ["near", F.coalesce("own_seq", sequence("far", "near"))]),
    }
    if calls is not None:
        refs, members = calls.refs.withColumnRenamed("caller_id", "near"), calls.members.withColumnRenamed("symbol_id", "near")
        tables |= {"by_caller": (refs, "near", ["near", "cls", "location"]), "by_class": (refs, "cls", ["cls", "near", "location"]), "of_class": (members, "cls", ["cls", "near"]), "of_symbol": (members, "near", ["near", "cls"])}
    found = {}

    def put(name: str, df: DataFrame, key: str, order: list) -> None:
        by = df.columns
        # what rows are dealt and sorted by is made on either side of the shuffle, not sent through it
        dealt = df.repartitionByRange(parts, part(F.col(key), parts), *order).withColumns({"part": part(F.col(key), parts)} | {f"__{i}": c for i, c in enumerate(order) if isinstance(c, Column) and name in ("out", "back")})
        dealt = dealt.sortWithinPartitions("part", *[f"__{i}" if f"__{i}" in dealt.columns else c for i, c in enumerate(order)]).select(*by, "part")
        dealt.write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/{name}")
        found[name] = spark.read.schema(dealt.schema).parquet(f"{folder}/{name}")

    for name, (df, key, order) in tables.items():
        put(name, df, key, order)
    put("degrees", _degrees(found["out"], found["back"], calls), "id", ["id", "kind"])
    found |= {"out": _unpacked(found["out"], "src"), "back": _unpacked(found["back"], "dst")}
    kept = Calls(*[found[c] for c in Calls._fields]) if calls is not None else None
    return Graph(found["nodes"], found["out"], found["back"], parts, kept, found["degrees"], found["touches"])


def validate(direction: str, kinds: Sequence[str] | None, depth: int, limit: int) -> None:
    if direction not in DIRECTIONS:
        raise VerbError("bad_request", f"unknown direction {direction}")
    if kinds is not None and (not kinds or set(kinds) - set(EDGE_KINDS)):
        raise VerbError("bad_request", "no edge kinds, or unknown ones")
    if not 1 <= depth <= MAX_DEPTH or not 1 <= limit <= MAX_LIMIT:
        raise VerbError("bad_request", "depth or limit out of range")


def node(graph: Graph, node_id: str) -> DataFrame:
    one = graph.nodes.where(F.col("id") == node_id)
    return one.drop("part") if graph.parts is None else one.where(F.col("part") == part(F.lit(node_id), graph.parts)).drop("part")


def hydrate(graph: Graph, page: DataFrame) -> DataFrame:
    """page (column id, at most some thousand rows) with kind, name and path of its nodes; one that is missing is an error."""
    found = graph.at(graph.nodes, page).join(F.broadcast(page.select("id")), "id", "left_semi").select("id", "kind", "name", "path")
    lost = F.raise_error(F.concat(F.lit("a node of an edge is missing: "), F.col("id"))).cast("string")
    return page.join(found, "id", "left").withColumn("kind", F.coalesce("kind", lost))


def sides(graph: Graph, of: DataFrame, cap: int | None = None, far: DataFrame | None = None) -> DataFrame:
    """Edges on either side of the nodes of (column id): near, far, out and the edge; a self-loop has two rows.

    With cap, of the factorised ones at least each node's first cap by edge_seq on either side; with far (column id), of these only those to its nodes.
    """
    of = graph.few(of.select("id"), "asked")
    both = graph.at(graph.out, of).unionByName(graph.at(graph.back, of)).join(of.select(F.col("id").alias("near")), "near", "left_semi")
    return both if graph.calls is None else both.unionByName(_calls_of(graph, of, cap, far))


def _first(rows: DataFrame, by: Sequence[str], order: Sequence[str], cap: int | None) -> DataFrame:
    if cap is None:
        return rows
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= cap).drop("r")


def _calls_of(graph: Graph, of: DataFrame, cap: int | None, far: DataFrame | None) -> DataFrame:
    """CALLS of the nodes of, expanded. All edges of a node with a class are in the order of the class's members, those of a member with it in that
    of its references, so that each list is cut at the cap before it is expanded."""
    calls, near = graph.calls, of.select(F.col("id").alias("near"))
    only = (lambda rows, c: rows) if far is None else lambda rows, c: rows.join(far.select(F.col("id").alias(c)), c, "left_semi")
    mine = graph.few(graph.at(calls.by_caller, of).join(near, "near", "left_semi").select(F.col("near").alias("src"), "cls", "confidence", "location"), "references")
    classes = graph.few(mine.select("cls").distinct(), "classes")
    to = only(graph.at(calls.of_class, classes, "cls").join(classes, "cls", "left_semi").select("cls", F.col("near").alias("dst")), "dst")
    out = mine.join(_first(to, ["cls"], ["dst"], cap), "cls")
    held = graph.few(graph.at(calls.of_symbol, of).join(near, "near", "left_semi").select("cls", F.col("near").alias("dst")), "members")
    classes = graph.few(held.select("cls").distinct(), "classes")
    named = graph.at(calls.by_class, classes, "cls").join(classes, "cls", "left_semi").select("cls", F.col("near").alias("src"), "confidence", "location")
    back = held.join(_first(only(named, "src"), ["cls"], ["src", F.asc_nulls_first("location")], cap), "cls")
    return _call(out, "src").unionByName(_call(back, "dst"))


def counts(graph: Graph, of: DataFrame) -> DataFrame:
    """id, kind, outs, ins, loops of the nodes of; a written graph has them, of another they are counted."""
    ids_ = of.select("id")
    if graph.degrees is not None:
        return graph.at(graph.degrees, of).join(ids_, "id", "left_semi")
    each = sides(graph._replace(calls=None), of).groupBy(F.col("near").alias("id"), "kind")
    told = each.agg(F.count_if("out").alias("outs"), F.count_if(~F.col("out")).alias("ins"), F.count_if(F.col("out") & (F.col("src") == F.col("dst"))).alias("loops"))
    return told if graph.calls is None else told.unionByName(_counted_calls(graph, of))


def _counted_calls(graph: Graph, of: DataFrame) -> DataFrame:
    """The rows of counts for factorised CALLS."""
    if graph.degrees is not None:
        return graph.at(graph.degrees, of).join(of.select("id"), "id", "left_semi").where("kind = 'CALLS'")
    of = graph.few(of.select("id"), "asked")
    near = lambda rows: rows.join(of.select(F.col("id").alias("near")), "near", "left_semi").withColumnRenamed("near", "id")
    mine, held = graph.few(near(graph.calls.by_caller).select("id", "cls", "n"), "references"), graph.few(near(graph.calls.of_symbol).select("id", "cls"), "members")
    classes = graph.few(held.select("cls").distinct(), "classes")
    return _summed(_call_degrees(mine, held, graph.calls.by_class.select("cls").join(classes, "cls", "left_semi")))


def edge_summary(graph: Graph, of: DataFrame) -> DataFrame:
    """id, direction, kind, count, provenance (a map from provenance to count) of the nodes of; factorised CALLS, all of one provenance, are counted, not expanded."""
    told = sides(graph._replace(calls=None), of).groupBy(F.col("near").alias("id"), F.when(F.col("out"), "out").otherwise("in").alias("direction"), "kind", "provenance").agg(F.count(F.lit(1)).alias("n"))
    if graph.calls is not None:
        calls = _counted_calls(graph, of)
        rows = F.explode(F.array(F.struct(F.lit("out").alias("direction"), F.col("outs").alias("n")), F.struct(F.lit("in").alias("direction"), F.col("ins").alias("n")))).alias("x")
        told = told.unionByName(calls.select("id", "kind", F.lit("syntactic").alias("provenance"), rows).select("id", "x.direction", "kind", "provenance", "x.n").where("n > 0"))
    return told.groupBy("id", "direction", "kind").agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("provenance", "n")))).alias("provenance"))


def incident_edges(graph: Graph, of: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """Per node its first cap incident edges by edge_seq, each once; capped tells whether there are more.

    The cut by row number is made before the shuffle too, so that of a node of very many edges each task sends at most cap + 1.
    """
    each = sides(graph, of, cap + 1).where("NOT out OR src <> dst")  # a self-loop from its target: lists of references are cut with it in them
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("near").orderBy("edge_seq"))).where(F.col("r") <= cap + 1)
    return first.withColumn("capped", F.max("r").over(Window.partitionBy("near")) > cap).where(F.col("r") <= cap).drop("r")


def follows(direction: str) -> Column:
    """Whether an incident edge is crossed from its near node; a self-loop leads nowhere new."""
    return {"out": F.col("src") == F.col("near"), "in": F.col("dst") == F.col("near"), "both": F.lit(True)}[direction]


class Reach(NamedTuple):
    """seen: id, depth, ext of the nodes reached, the origin at depth 0 with them; examined: the edges looked at, with level, n (their number) and capped; spent: whether there were more than the budget."""

    seen: DataFrame
    examined: DataFrame
    spent: bool


def discover(graph: Graph, origin: DataFrame, direction: str = "both", kinds: Sequence[str] | None = None, depth: int = 1, repo: str = "", budget: int = BUDGET) -> Reach:
    """Breadth-first levels, at most three, each written: a frontier has at most budget nodes and is broadcast.

    Each level examines the incident edges of its frontier in the order of (frontier, src, dst, kind, location, edge_seq) until the budget is
    spent. Where a node's edges start in that order are sums over the frontier's degrees, so that only nodes that start within the budget
    are read: at most the budget and one node's cap of edges a level.
    """
    graph = graph.of_kinds(kinds)
    ext = lambda c: ids.qualify(F.col(c), F.lit(repo)) if repo else F.col(c)
    frontier = settle(origin.select("id", F.lit(0).alias("depth")).withColumn("ext", ext("id")), "frontier")
    seen, levels, used, spent = [frontier], [], 0, False
    for level in range(1, depth + 1):
        sizes = counts(graph, F.broadcast(frontier)).groupBy("id").agg(F.least(F.lit(NODE_CAP), F.sum(F.col("outs") + F.col("ins") - F.col("loops"))).alias("size"))
        # a row a node of the frontier, at most budget
        starts = frontier.join(sizes, "id").withColumn("start", F.sum("size").over(Window.orderBy("ext")) - F.col("size"))
        starts = settle(starts.select(F.col("id").alias("near"), F.col("ext").alias("near_ext"), "size", "start"), "starts")
        total = starts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        chosen = starts.where(F.col("start") < budget - used)
        within = incident_edges(graph, F.broadcast(chosen.select(F.col("near").alias("id")))).join(F.broadcast(chosen.select("near", "near_ext", "start")), "near")
        order = Window.partitionBy("near").orderBy("src", "dst", "kind", F.asc_nulls_first("location"), "edge_seq")
        numbered = within.withColumn("n", used + F.col("start") + F.row_number().over(order)).where(F.col("n") <= budget).drop("start")
        looked = settle(numbered.withColumn("level", F.lit(level)), "examined")
        spent, used = spent or used + total > budget, min(budget, used + total)
        levels.append(looked)
        found = looked.where(follows(direction)).select(F.col("far").alias("id")).distinct()
        for before in seen:  # at most budget nodes each
            found = found.join(F.broadcast(before.select("id")), "id", "left_anti")
        frontier = settle(found.withColumn("depth", F.lit(level)).withColumn("ext", ext("id")).select("id", "depth", "ext"), "frontier")
        seen.append(frontier)
    return Reach(reduce(DataFrame.unionByName, seen), reduce(DataFrame.unionByName, levels), spent)


def ranked(seen: DataFrame) -> DataFrame:
    """seen with rank, the origin's 0, in the order of (depth, ext); at most a budget of rows."""
    return seen.withColumn("rank", F.row_number().over(Window.orderBy("depth", "ext")) - 1)


def page(seen: DataFrame, limit: int, after: tuple[int, str] | None = None) -> DataFrame:
    """The nodes of a page: depth, ext, id, rank in the order of (depth, ext), after a position that needn't exist; more tells whether there are further ones."""
    rows = ranked(seen).where("depth > 0")
    if after is not None:
        rows = rows.where((F.col("depth") > after[0]) | ((F.col("depth") == after[0]) & (F.col("ext") > after[1])))
    first = rows.orderBy("rank").limit(limit + 1)
    numbered = first.withColumn("i", F.row_number().over(Window.orderBy("rank")))
    return numbered.withColumn("more", F.max("i").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("i") <= limit).drop("i")


def page_edges(graph: Graph, seen: DataFrame, paged: DataFrame, kinds: Sequence[str] | None = None, cap: int = PAGE_EDGE_CAP) -> DataFrame:
    """The edges among the nodes seen that belong to a page: to the page of the end that ranks later; self-loops to their node's, the origin's to the first.

    Read from the page's nodes, so each edge comes from the end that ranks later; the other end is looked up among the nodes seen, at most a budget.
    """
    rank = settle(ranked(seen).select("id", "rank"), "ranks")
    origin = rank.where("rank = 0").join(paged.where("rank = 1").select(F.lit(True)), how="left_semi")
    of = settle(paged.select("id", "rank").unionByName(origin), "page")
    each = sides(graph.of_kinds(kinds), F.broadcast(of), far=F.broadcast(rank)).where("out OR src <> dst")
    near, far = (F.broadcast(x.withColumnsRenamed({"id": k, "rank": f"{k}_rank"})) for x, k in ((of, "near"), (rank, "far")))
    mine = each.join(near, "near").join(far, "far").where("near_rank > far_rank OR src = dst").withColumn("rank", F.greatest(F.lit(1), "near_rank"))
    return mine.orderBy("rank", "src", "dst", "kind", F.asc_nulls_first("location"), "edge_seq").limit(cap).select(*EDGE, "rank")


def neighbors(graph: Graph, node_id: str, direction: str = "both", kinds: Sequence[str] | None = None, depth: int = 1, limit: int = 100, after: tuple[int, str] | None = None, repo: str = "") -> DataFrame:
    """A page of the neighbourhood of a node: depth, ext, id, kind, name, path, rank, more."""
    validate(direction, kinds, depth, limit)
    reach = discover(graph, node(graph, node_id), direction, kinds, depth, repo)
    return hydrate(graph, settle(page(reach.seen, limit, after), "page"))

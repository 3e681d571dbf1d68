"""Building the graph: histories, merging, integrity, counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import ids
from lattica.operators.resolve import References, product
from lattica.schema import BODY_BYTES, FILE_BYTES, PROVENANCES
from lattica.sources.scratch import settle

IDENTITY = ["src", "dst", "kind", "location"]
#: How many rows of hashes a task groups.
HASHES = 1_000_000


def parse_records(tokens: Iterator[str]) -> Iterator[tuple[str, int, str, str, str, list[str]]]:
    """sha, time, author, email, subject, paths of the records of a NUL-framed log: five headers, then, behind an empty token or not,
    paths, the first of which starts with a line feed, until an empty token or the next record. Records with a bad sha or time are left out.
    At most one record and the five tokens behind it are held."""
    ahead: deque[str] = deque()

    def have(n: int) -> bool:
        while len(ahead) < n:
            if (x := next(tokens, None)) is None:
                return False
            ahead.append(x)
        return True

    starts = lambda: have(5) and _is_sha(ahead[0]) and ahead[1].isdigit()
    while have(5):
        sha, time, author, email, subject = (ahead.popleft() for _ in range(5))
        if have(1) and ahead[0] == "":
            ahead.popleft()
        paths = []
        while have(1) and ahead[0] != "" and (paths or ahead[0].startswith("\n")) and not starts():
            paths.append(ahead.popleft() if paths else ahead.popleft().removeprefix("\n"))
        if paths and have(1) and ahead[0] == "":
            ahead.popleft()
        sha = sha.removeprefix("\n")
        if _is_sha(sha) and time.isdigit():
            yield sha, int(time), author, email, subject, [p for p in paths if p]


def parse_history(text: str) -> list[tuple[str, int, str, str, str, list[str]]]:
    """The records of a log that is held whole."""
    return list(parse_records(iter(text.split("\0"))))


def _is_sha(text: str) -> bool:
    text = text.removeprefix("\n")
    return len(text) in (40, 64) and not set(text) - set("0123456789abcdef")


def history_graph(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of commits (sha, ct, author, email, subject, paths): a Commit each, a Contributor per trimmed e-mail that isn't empty (the first commit's name, blank names null), AUTHORED and TOUCHES."""
    email = F.trim("email")
    known = commits.withColumn("email", email)
    commit = F.concat(F.lit("commit:"), F.col("sha"))
    none = F.lit(None)
    first = known.where("email <> ''").groupBy("email").agg(F.min_by("author", F.struct((-F.col("ct")).alias("t"), "sha")).alias("author"))
    people = first.select(F.concat(F.lit("contributor:"), F.col("email")).alias("id"), F.lit("Contributor").alias("kind"), F.when(F.trim("author") != "", F.col("author")).alias("name"), none.cast("long").alias("committed_at"))
    nodes = known.select(commit.alias("id"), F.lit("Commit").alias("kind"), F.col("subject").alias("name"), F.col("ct").alias("committed_at")).unionByName(people)
    authored = known.where("email <> ''").select(F.concat(F.lit("contributor:"), F.col("email")).alias("src"), commit.alias("dst"), F.lit("AUTHORED").alias("kind"))
    touches = known.select(commit.alias("src"), F.explode("paths").alias("path")).select("src", F.concat(F.lit("file:"), F.col("path")).alias("dst"), F.lit("TOUCHES").alias("kind")).distinct()
    return nodes, authored.unionByName(touches).select("src", "dst", "kind", F.lit("extracted").alias("provenance"), F.lit(1.0).alias("confidence"), none.cast("string").alias("location"))


def merge_history(edges: DataFrame, history: DataFrame, files: DataFrame) -> DataFrame:
    """The union, of TOUCHES only those to files (column id) that are there."""
    kept = history.where("kind = 'TOUCHES'").join(files.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges.unionByName(kept.select(edges.columns)).unionByName(history.where("kind <> 'TOUCHES'").select(edges.columns))


def dedup_edges(edges: DataFrame, order: str = "edge_seq") -> DataFrame:
    """Of rows that agree in everything, the confidence's bits included, the first."""
    same = Window.partitionBy(*IDENTITY, "provenance", F.hex(F.col("confidence").cast("string").cast("binary"))).orderBy(order)
    return edges.withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__r")


def edge_conflicts(edges: DataFrame) -> DataFrame:
    """Identities with more than one derivation: a build that has any fails.

    Hashes of identities are grouped first, some HASHES rows a task, with the bounds of their derivations as numbers; only rows of a hash that may
    have two are grouped as they are. A clash costs work but changes nothing. Edges are read twice.
    """
    told = edges.where("provenance IS NOT NULL AND confidence IS NOT NULL").withColumn("__h", F.xxhash64(*IDENTITY))  # others count for nothing
    known = F.array_position(F.array(*map(F.lit, PROVENANCES)), F.col("provenance"))  # 0: none of them, so that its rows are compared
    rows = settle(told.select("__h", known.cast("int").alias("p"), F.col("confidence").alias("c")), "hashes")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // HASHES + 1)
    bounds = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("p", "c")]
    found = rows.repartition(tasks, "__h").groupBy("__h").agg(F.count(F.lit(1)).alias("n"), *bounds)
    twice = settle(found.where("n > 1 AND (min_p = 0 OR min_p <> max_p OR min_c <> max_c)").select("__h"), "conflicts")
    return told.join(twice, "__h", "left_semi").groupBy(*IDENTITY).agg(F.count_distinct("provenance", "confidence").alias("n")).where("n > 1")


def call_conflicts(calls: References) -> DataFrame:
    """edge_conflicts of factorised CALLS. Only references that share caller and location can have any, so that these alone are expanded; the others
    are told from them by a hash, of which a clash costs work but changes nothing."""
    same = F.xxhash64("caller_id", "location")
    twice = calls.refs.groupBy(same.alias("h")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    return edge_conflicts(calls._replace(refs=calls.refs.withColumn("h", same).join(twice, "h", "left_semi").drop("h")).edges())


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def symbol_ordinals(symbols: DataFrame) -> DataFrame:
    """symbols (path, name, pos) with their ids: the n-th of a name in a file has a suffix from the second on."""
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("pos"))
    return symbols.withColumn("id", ids.symbol_id(F.col("path"), F.col("name"), n))


def defines(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.concat(F.lit("file:"), F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("kind"), F.lit("syntactic").alias("provenance"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("location"))


def packages(imports: DataFrame) -> DataFrame:
    """A Package per import path."""
    return imports.select("import_path").distinct().select(F.concat(F.lit("pkg:"), F.col("import_path")).alias("id"), F.lit("Package").alias("kind"), F.col("import_path").alias("name"))


def extends(found: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Embeddings (src, dst): one of an interface keeps only targets that are interfaces (column id)."""
    i = interfaces.select("id")
    of_iface = found.join(i.withColumnRenamed("id", "src"), "src", "left_semi").join(i.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return of_iface.unionByName(found.join(i.withColumnRenamed("id", "src"), "src", "left_anti").select(of_iface.columns))


def emit(*phases: DataFrame | References) -> DataFrame:
    """The union with edge_seq in the order of the phases, then of file, site and candidate (columns path, site, dst): a sortable text, no global numbering.

    A phase of factorised calls has path and site among its references; of its edge_seq all but the candidate is made a reference, not a row.
    """
    out = None
    for i, p in enumerate(phases):
        before = F.concat_ws("\x01", F.lpad(F.lit(i).cast("string"), 3, "0"), "path", F.lpad(F.col("site").cast("string"), 10, "0"))
        if isinstance(p, References):
            refs = settle(p.refs.select("path", "site", F.col("caller_id").alias("src"), "location", "cls", before.alias("before")), "references")
            rows = product(refs, settle(p.members.select("cls", F.col("symbol_id").alias("dst")), "members"), "cls")
            p = rows.withColumn("edge_seq", F.concat_ws("\x01", "before", "dst")).select("path", "site", "src", "dst", "location", "edge_seq")
        else:
            p = p.withColumn("edge_seq", F.concat_ws("\x01", before, "dst"))
        out = p if out is None else out.unionByName(p)
    return out


def counts(nodes: DataFrame, edges: DataFrame, calls: References | None = None) -> DataFrame:
    """How many nodes and edges; calls: CALLS that aren't among edges, counted by their references, as many each as its class has members."""
    rows = edges.agg(F.count(F.lit(1)).alias("edges"))
    if calls is not None:
        rows = rows.unionByName(calls.refs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))).agg(F.sum("edges").alias("edges"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(rows)


def cap_body(body: bytes | None, limit: int = BODY_BYTES) -> str | None:
    """A file's text, cut at a character's end; null where it isn't UTF-8."""
    if body is None:
        return None
    try:
        text = bytes(body).decode()
    except UnicodeDecodeError:
        return None
    raw = text.encode()[:limit]
    return raw.decode(errors="ignore")


def degrade(files: DataFrame, limit: int = FILE_BYTES) -> DataFrame:
    """files (path, length, content) with the content of those only that aren't too long; every file keeps its row."""
    return files.withColumn("content", F.when(F.col("length") <= limit, F.col("content")))

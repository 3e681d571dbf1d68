"""Sources and sinks: directory trees and published artifacts."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import ids
from lattica.operators import build, postings
from lattica.operators.graph import sequence
from lattica.operators.resolve import References
from lattica.schema import FILE_BYTES, SCHEMA_VERSION

FILE_ROWS = 1_000_000  # of a segment, so that one task can hold a file to digest it


def entries(root: str) -> Iterator[tuple[str, bool]]:
    """path, symlink of every entry below a root that is no directory, by path within a folder; names that aren't UTF-8 are skipped."""
    for folder, dirs, names in os.walk(root):
        dirs.sort()
        for name in sorted([*names, *(d for d in dirs if os.path.islink(os.path.join(folder, d)))]):
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root)
            try:
                path.encode()
            except UnicodeEncodeError:
                continue
            yield path, os.path.islink(full)


def scan_trees(roots: DataFrame, batch: int = 10_000) -> DataFrame:
    """repo, path, symlink of the entries below each root (repo, root), a folder that the executors see; each is walked where its row is."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for repo, root in zip(frame["repo"], frame["root"]):
                found = entries(root)
                while rows := list(islice(found, batch)):
                    yield pd.DataFrame([(repo, *r) for r in rows], columns=["repo", "path", "symlink"])

    return roots.select("repo", "root").mapInPandas(walk, "repo string, path string, symlink boolean")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, symlink of the entries below one root, by path."""
    return scan_trees(spark.createDataFrame([("", root)], "repo string, root string")).select("path", "symlink").orderBy("path")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, language, length, content (null where too long, a link or not UTF-8) of every entry of scan_tree; contents are read by the executors."""
    paths = scan_tree(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root if "://" in root else f"file:{os.path.abspath(root)}"
    bodies = found.where(F.col("length") <= FILE_BYTES).select(F.substring("path", len(prefix) + 2, 1 << 20).alias("path"), "length", "content")
    body = F.pandas_udf(lambda s: s.map(build.cap_body), "string")
    rows = paths.join(bodies, "path", "left").withColumn("text", body("content"))
    return rows.select("path", ids.language(F.col("path")).alias("language"), "length", F.when(~F.col("symlink"), F.col("text")).alias("content"))


class Store:
    """Artifacts of ``<root>/shards/<repo>/<revision>/``: Parquet segments in a folder of each attempt's own, and, last, the manifest, which
    names the attempt in force and has the lengths and digests of every segment's files.

    What is put in force (a manifest, a version of a pointer) is written whole under another name and then linked or renamed to its own if
    that isn't taken: it is there with all its content or not at all, and one of two publishers wins. On object stores that is as atomic as
    their connector's rename. A manifest that can't be read, of whatever cause, is none: it is moved aside, and the next publisher's takes its place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def revision(self, commit: str, source: str) -> str:
        return f"{commit}-{source}-v{SCHEMA_VERSION}"

    def put(self, value: dict, *at: str) -> bool:
        """Writes a value where nothing is; whether it was the first. Nobody sees a part of it."""
        path = self._path(*at)
        draft = self._path(*at[:-1], f".{at[-1]}-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a rename would replace what is there
                try:
                    os.link(draft.toUri().getPath(), path.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self.fs.exists(path) and self.fs.rename(draft, path)
        finally:
            self.fs.delete(draft, False)

    def value(self, *at: str) -> dict | None:
        """What put has written; None if nothing is there or it can't be read."""
        path = self._path(*at)
        if not self.fs.exists(path):
            return None
        text = "\n".join(r["value"] for r in self.spark.read.text(path.toString()).collect())
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def _set_aside(self, *at: str) -> None:
        """Moves something unreadable out of the way; if it has become readable meanwhile it is put back."""
        aside = f".torn-{uuid.uuid4().hex}"
        if self.fs.rename(self._path(*at), self._path(*at[:-1], aside)) and (whole := self.value(*at[:-1], aside)) is not None:
            self.put(whole, *at)

    def publish(self, repo: int, commit: str, nodes: DataFrame, edges: DataFrame, docs: DataFrame, source: str = "syntactic", wanted: Callable[[], bool] = lambda: True, calls: References | None = None) -> dict | None:
        """The manifest in force: this one's, or the one that was there first; what a loser wrote goes, never what the winner did.

        wanted is asked again right before the manifest is put in force: if the repository is no longer to be published, nothing is, and null is
        returned; and once more after it, so that of a repository that is given up in between no artifact stays.

        calls: CALLS that aren't among edges. They stay factorised in the segment of the edges, which has three folders then (rows, references,
        members), so that what is written grows with the references; the manifest counts them as the edges that they are, and read expands them.
        """
        if build.edge_conflicts(edges).limit(1).count():
            raise ValueError("edges of one identity differ in their derivation")
        at = ["shards", str(repo), self.revision(commit, source)]
        if (old := self.manifest(repo, at[2])) is not None:
            return old
        attempt = f"attempt-{uuid.uuid4().hex}"
        folder = "/".join([self.root, *at, attempt])
        rows = "edges" if calls is None else "edges/rows"
        tables = {"nodes": nodes, rows: _packed(edges)}
        if calls is not None:
            tables |= {"edges/references": calls.refs.select("ref_id", "caller_id", "location", "cls", "n", "confidence"), "edges/members": calls.members.select("cls", "symbol_id")}
        for name, df in tables.items():
            df.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(f"{folder}/{name}")
        counts = build.counts(self.spark.read.parquet(f"{folder}/nodes"), self.spark.read.parquet(f"{folder}/{rows}")).first()
        n_edges = counts[1]
        if calls is not None:
            kept = self._calls(folder)
            if build.call_conflicts(kept).limit(1).count() or self.spark.read.parquet(f"{folder}/{rows}").where("kind = 'CALLS'").limit(1).count():
                self.fs.delete(self._path(*at, attempt), True)
                raise ValueError("edges of one identity differ in their derivation, or CALLS are among the edges and beside them")
            n_edges += kept.number()
        index = postings.build(docs, folder)
        manifest = {"schema_version": SCHEMA_VERSION, "commit": commit, "pass": source, "attempt": attempt, "counts": {"nodes": counts[0], "edges": n_edges}, "parts": index.parts, "segments": self._digests(folder, ["blocks", "docs", "edges", "nodes", "stats"])}
        if not wanted():
            self.fs.delete(self._path(*at, attempt), True)
            return None
        while not self.put(manifest, *at, "manifest.json"):
            if (old := self.manifest(repo, at[2])) is not None:
                self.fs.delete(self._path(*at, attempt), True)
                return old
            self._set_aside(*at, "manifest.json")
        if not wanted():
            self.delete(repo, at[2])
            return None
        return manifest

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Names (below folder) and lengths of a segment's data files, from a listing."""
        found, each = [], self.fs.listFiles(self.jvm.org.apache.hadoop.fs.Path(folder), True)
        base = self.jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
        while each.hasNext():
            status = each.next()
            name = status.getPath().toUri().getPath().removeprefix(base)
            if name.rpartition("/")[2].startswith("part-"):
                found.append((name, status.getLen()))
        return sorted(found)

    def _digests(self, folder: str, names: list[str]) -> dict[str, dict]:
        """For every segment its bytes, a digest of its files' names and lengths, and one of their names and contents, which the executors read; a row a file comes to the driver."""
        out = {}
        for name in names:
            files = self._files(f"{folder}/{name}")
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
            told = sorted((r["file"], r["sha256"]) for r in found.select(F.element_at(F.split("path", f"/{name}/"), -1).alias("file"), F.sha2("content", 256).alias("sha256")).collect())
            out[name] = {"sha256": _digest(told), "files": _digest(files), "bytes": sum(n for _, n in files)}
        return out

    def manifest(self, repo: int, revision: str) -> dict | None:
        return self.value("shards", str(repo), revision, "manifest.json")

    def published(self, repo: int, commit: str, source: str = "syntactic", contents: bool = False) -> dict | None:
        """The manifest if it agrees with its revision and every segment's files are there in the lengths that it says; with contents, in its bytes too."""
        revision = self.revision(commit, source)
        m = self.manifest(repo, revision)
        if m is None or f"{m.get('commit')}-{m.get('pass')}-v{m.get('schema_version')}" != revision:
            return None
        folder = "/".join([self.root, "shards", str(repo), revision, m["attempt"]])
        for name, told in m["segments"].items():
            if not self.fs.exists(self._path("shards", str(repo), revision, m["attempt"], name)) or _digest(self._files(f"{folder}/{name}")) != told["files"]:
                return None
        return m if not contents or self._digests(folder, sorted(m["segments"])) == m["segments"] else None

    def _folder(self, repo: int, revision: str) -> tuple[dict, str]:
        if (m := self.manifest(repo, revision)) is None:
            raise FileNotFoundError(f"{repo}/{revision} is not published")
        return m, f"{self.root}/shards/{repo}/{revision}/{m['attempt']}"

    def _calls(self, folder: str) -> References:
        return References(self.spark.read.parquet(f"{folder}/edges/references"), self.spark.read.parquet(f"{folder}/edges/members"))

    def calls(self, repo: int, revision: str) -> References | None:
        """The CALLS that were published factorised, if they were."""
        folder = self._folder(repo, revision)[1]
        return self._calls(folder) if self.fs.exists(self._path("shards", str(repo), revision, folder.rpartition("/")[2], "edges", "references")) else None

    def read(self, repo: int, revision: str, table: str) -> DataFrame:
        """A published table; edges with all CALLS, a row each."""
        folder = self._folder(repo, revision)[1]
        if table != "edges":
            return self.spark.read.parquet(f"{folder}/{table}")
        rows = self.rows(repo, revision)
        if (calls := self.calls(repo, revision)) is None:
            return rows
        return rows.unionByName(calls.edges(kept=True).withColumn("edge_seq", sequence()).select(rows.columns))

    def rows(self, repo: int, revision: str) -> DataFrame:
        """The edges that were published as rows: all but those of calls. An edge_seq that follows from the rest isn't written but made here."""
        folder = self._folder(repo, revision)[1]
        rows = self.spark.read.parquet(f"{folder}/edges" if self.calls(repo, revision) is None else f"{folder}/edges/rows")
        return rows.withColumn("edge_seq", F.coalesce("edge_seq", sequence())) if "edge_seq" in rows.columns else rows

    def index(self, repo: int, revision: str) -> postings.Index:
        m, folder = self._folder(repo, revision)
        return postings.load(self.spark, folder, m["parts"])

    def delete(self, repo: int, revision: str) -> None:
        """The manifest first, so that no reader finds half an artifact, then the rest, then a manifest that came meanwhile."""
        at = ["shards", str(repo), revision]
        self.fs.delete(self._path(*at, "manifest.json"), False)
        self.fs.delete(self._path(*at), True)
        self.fs.delete(self._path(*at, "manifest.json"), False)

    def pointer(self, repo: int) -> dict | None:
        """The version in force of a repository's pointer: version, revision, fence. Versions are files of their own, each put once."""
        at = self._path("pointers", str(repo))
        if not self.fs.exists(at):
            return None
        versions = sorted((int(f.getPath().getName().removesuffix(".json")) for f in self.fs.listStatus(at) if not f.getPath().getName().startswith(".")), reverse=True)
        return next((found for v in versions if (found := self.value("pointers", str(repo), f"{v:012d}.json")) is not None), None)

    def point(self, repo: int, revision: str, expected: int, fence: int) -> bool:
        """Compare and swap: the pointer goes to a published revision if its version is still the expected one (0 for none) and nobody with a higher fence was here."""
        if self.manifest(repo, revision) is None:
            raise FileNotFoundError(f"{repo}/{revision} is not published")
        now = self.pointer(repo)
        if (now["version"] if now else 0) != expected or now and now["fence"] > fence:
            return False
        at = ["pointers", str(repo), f"{expected + 1:012d}.json"]
        while not self.put({"version": expected + 1, "revision": revision, "fence": fence, "repo": repo}, *at):
            if self.value(*at) is not None:
                return False
            self._set_aside(*at)
        return True

    def pointers(self) -> DataFrame:
        """repo, version, revision, fence of all pointers in force."""
        log = self.spark.read.schema("repo long, version long, revision string, fence long").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(f"{self.root}/pointers")
        return current(log)


def current(log: DataFrame) -> DataFrame:
    """repo, version, revision, fence in force of a log of pointers (those columns): of each repository the last version that no earlier one had fenced off; rows without a version are torn."""
    whole = log.where("version IS NOT NULL AND revision IS NOT NULL")
    before = F.max("fence").over(Window.partitionBy("repo").orderBy("version").rowsBetween(Window.unboundedPreceding, -1))
    held = whole.withColumn("before", before).where(F.col("before").isNull() | (F.col("fence") >= F.col("before")))
    return held.groupBy("repo").agg(F.max(F.struct("version", "revision", "fence")).alias("x")).select("repo", "x.*")


def _packed(edges: DataFrame) -> DataFrame:
    """edges with edge_seq only where it isn't that of sequence()."""
    return edges.withColumn("edge_seq", F.when(F.col("edge_seq") != sequence(), F.col("edge_seq"))) if "edge_seq" in edges.columns else edges


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value).encode()).hexdigest()

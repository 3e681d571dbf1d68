"""Git repositories: a mirror that is cloned or fetched, its head, its log and the tree of a commit."""

from __future__ import annotations

import os
import shutil
import subprocess
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lattica.operators import build

#: The log's format and options.
GIT_LOG = ("log", "--no-renames", "--name-only", "-z", "--pretty=%H%x00%ct%x00%an%x00%ae%x00%s%x00")
COMMITS = "sha string, ct long, author string, email string, subject string, paths array<string>"


def run(*words: str, timeout: int = 600, cwd: str | None = None) -> str:
    return subprocess.run(["git", *words], capture_output=True, timeout=timeout, check=True, cwd=cwd).stdout.decode("utf-8", "replace")


def remote_head(url: str, timeout: int = 60) -> str | None:
    """The commit that a remote's HEAD names; null for an empty repository."""
    out = run("ls-remote", url, "HEAD", timeout=timeout).split()
    return out[0] if out else None


def remote_heads(repos: DataFrame, timeout: int = 60) -> DataFrame:
    """repos (repo, url) with head (null if there is none) and error (null if the probe went well), each probed by the executor that holds its row."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for repo, url in zip(frame["repo"], frame["url"]):
                try:
                    rows.append((repo, url, remote_head(url, timeout), None))
                except (subprocess.SubprocessError, OSError) as e:
                    rows.append((repo, url, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["repo", "url", "head", "error"])

    return repos.select("repo", "url").mapInPandas(probe, "repo string, url string, head string, error string")


def tokens(stream, size: int = 1 << 20) -> Iterator[str]:
    """The NUL-ended parts of a stream, read in steps."""
    rest = b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\0")
        for x in whole:
            yield x.decode("utf-8", "replace")
    yield rest.decode("utf-8", "replace")


def log(git_dir: str, commit: str = "HEAD") -> Iterator[tuple]:
    """The records of a history, one after the other; the log itself is never held."""
    with subprocess.Popen(["git", "-C", git_dir, *GIT_LOG, commit], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as p:
        yield from build.parse_records(tokens(p.stdout))
    if p.returncode:
        raise subprocess.CalledProcessError(p.returncode, "git log")


def git_logs(repos: DataFrame, commit: str = "HEAD", batch: int = 10_000) -> DataFrame:
    """repo and its commits (sha, ct, author, email, subject, paths), a repository (repo, git_dir) a row, read where the row is."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["repo", "sha", "ct", "author", "email", "subject", "paths"]
        for frame in frames:
            for repo, git_dir in zip(frame["repo"], frame["git_dir"]):
                rows = []
                for r in log(git_dir, commit):
                    rows.append((repo, *r))
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return repos.select("repo", "git_dir").mapInPandas(read, f"repo string, {COMMITS}")


def git_log(spark: SparkSession, git_dir: str, commit: str = "HEAD") -> DataFrame:
    """The commits of one repository."""
    return git_logs(spark.createDataFrame([("", git_dir)], "repo string, git_dir string"), commit).drop("repo")


def sync(url: str, git_dir: str, timeout: int = 600) -> str | None:
    """Clones a mirror or fetches what is new, without what is gone, whole histories of shallow ones, with HEAD where the remote has it; returns its commit.

    A mirror that can't be fetched into is made anew, beside the old one, which is replaced only when the new one is whole.
    """
    if os.path.isdir(git_dir):
        try:
            return _fetch(url, git_dir, timeout)
        except subprocess.CalledProcessError:
            pass  # healed below
    fresh = f"{git_dir}.{uuid.uuid4().hex}"
    try:
        run("clone", "--quiet", "--mirror", url, fresh, timeout=timeout)
        head = _fetch(url, fresh, timeout)
        shutil.rmtree(git_dir, ignore_errors=True)
        os.rename(fresh, git_dir)
    finally:
        shutil.rmtree(fresh, ignore_errors=True)
    return head


def _fetch(url: str, git_dir: str, timeout: int) -> str | None:
    at = lambda *words: run("-C", git_dir, *words, timeout=timeout)
    at("remote", "set-url", "origin", url)
    whole = ["--unshallow"] if at("rev-parse", "--is-shallow-repository").strip() == "true" else []
    at("fetch", "--quiet", "--prune", *whole, "origin", "+refs/*:refs/*")
    said = at("ls-remote", "--symref", "origin", "HEAD").splitlines()
    if not said:
        return None
    if said[0].startswith("ref: "):
        at("symbolic-ref", "HEAD", said[0][5:].split("\t")[0])
    return at("rev-parse", "--verify", "HEAD^{commit}").strip()


def checkout(git_dir: str, commit: str, folder: str, timeout: int = 600) -> None:
    """The tree of a commit in a folder that isn't there yet; it appears whole or not at all. Nothing may lie outside it."""
    if len(commit) not in (40, 64) or set(commit) - set("0123456789abcdef"):
        raise ValueError("no commit")
    fresh = f"{folder}.{uuid.uuid4().hex}"
    os.makedirs(fresh)
    try:
        with subprocess.Popen(["git", "-C", git_dir, "archive", "--format=tar", commit], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as p:
            damage = None
            try:
                with tarfile.open(fileobj=p.stdout, mode="r|") as tar:
                    tar.extractall(fresh, filter="tar")
            except tarfile.ReadError as e:  # of an archive that ended early
                damage = e
            p.stdout.read()
            if p.wait(timeout):
                raise subprocess.CalledProcessError(p.returncode, "git archive")
            if damage:
                raise damage
        os.rename(fresh, folder)
    finally:
        shutil.rmtree(fresh, ignore_errors=True)

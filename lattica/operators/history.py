"""History of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.operators.graph import Graph, part
from lattica.sources.scratch import settle


def history(graph: Graph, file_id: str, limit: int = 50, since: int | None = None, after: tuple[int, str] | None = None) -> DataFrame:
    """The commits that touch a file, newest first, ids breaking ties: id, name, committed_at, date, author_id, author_name, one more row than limit if there are more.

    A written graph has the commits of a file in this order with all that a page shows but their authors, so a page reads the file's
    directory, and the page's edges to authors and their names.
    """
    touches = graph.touches
    if touches is None:
        commits = graph.nodes.where("kind = 'Commit'").select("id", "name", "committed_at")
        mine = graph.back.where((F.col("kind") == "TOUCHES") & (F.col("near") == file_id)).select("near", F.col("far").alias("id"))
        touches = graph.few(mine, "touches").join(commits, "id")
    else:
        touches = touches.where(F.col("part") == part(F.lit(file_id), graph.parts))
    touches = touches.where(F.col("near") == file_id)
    if since is not None:
        touches = touches.where(F.col("committed_at") >= since)
    if after is not None:
        at, last = after
        touches = touches.where((F.col("committed_at") < at) | ((F.col("committed_at") == at) & (F.col("id") > last)))
    page = settle(touches.select("id", "name", "committed_at").orderBy(F.desc("committed_at"), "id").limit(limit + 1), "history")
    authors = graph.at(graph.back.where("kind = 'AUTHORED'"), page).join(F.broadcast(page.select(F.col("id").alias("near"))), "near", "left_semi").select(F.col("near").alias("id"), F.col("far").alias("author_id"))
    told = settle(page.join(authors, "id", "left"), "history")  # a page's rows
    writers = told.where("author_id IS NOT NULL").select(F.col("author_id").alias("id")).distinct()
    people = graph.at(graph.nodes.where("kind = 'Contributor'"), writers).join(F.broadcast(writers), "id", "left_semi")
    names = people.select(F.col("id").alias("author_id"), F.col("name").alias("author_name"))
    return told.join(names, "author_id", "left").select("id", "name", "committed_at", ids.render_date(F.col("committed_at")).alias("date"), "author_id", "author_name")

"""The corpus pipeline: each stage calls one operator and takes what its predecessor kept, written as Parquet.

A stage returns a frame that reads intermediate tables; the next stage deletes these, and run() the outputs that no stage reads any more.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, line_dedup, packing, quality, simhash, substring_dedup


def counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows a text that was cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and from the others the lines that too many of their host hold.

    Defined cases, here and in each stage: those of the operator that it calls; an empty table stays empty; other columns stay.
    """
    return counted(quality.keep_good(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly, go; a text of which none is left is empty, a null one null."""
    return counted(line_dedup.remove_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id, a null one being the largest; of wordless texts one stays."""
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds go; rows without a doc_id are compared with none."""
    return counted(substring_dedup.substring_dedup(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as packed token sequences: a row a piece; a null or empty text is its end id alone."""
    return packing.pack_documents(docs)


_behind = threading.local()


def freeing(stage: Callable) -> Callable:
    """A stage that deletes the intermediate tables of the stages before it, which are written by then; what docs still reads stays.

    Tables are known by thread, so that pipelines that run side by side don't meet.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = common.forget(spark, getattr(_behind, "paths", []), docs)
        with common.noted() as made:
            out = stage(spark, docs, sf_dir)
        _behind.paths = left + made
        return out

    return run_stage


STAGES = [(name, freeing(f)) for name, f in (("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("substrings", substring_stage), ("packing", packing_stage))]

#: Packing, tokens and near duplicates are beyond SQL; the tests hold every stage against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with common.noted() as made:
            docs = common.materialise(out, f"stage-{name}")
        common.forget(spark, before)  # the output of the stage before, of which this one's is made
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)

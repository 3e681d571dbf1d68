"""What the operators of this subpackage share: the shared folder, row identities, word patterns.

Rows are identified by ``(doc_id, xxhash64(text))`` wherever a verdict has to find its way back to its row, so that
repeated rows get the same verdict, rows that only share an id don't get each other's, and no join multiplies rows.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters part words; Python's bytes.split() parts at the same ones.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Rows and number of the keys that are joined without a shuffle; bits of the bit map that keeps rows out of one.
HEAVY_ROWS, MOST_HEAVY, LOG2_MARKS = 1000, 1024, 22


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset on one machine, as in tests, a temporary one is made."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/lattica/{what}-{uuid.uuid4().hex}"


_kept = threading.local()


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """Collects the paths of the tables that this thread materialises meanwhile."""
    before, _kept.paths = getattr(_kept, "paths", None), []
    try:
        yield _kept.paths
    finally:
        if before is not None:
            before += _kept.paths
        _kept.paths = before


def forget(spark: SparkSession, paths: Sequence[str], read: DataFrame | None = None) -> list[str]:
    """Deletes materialised tables once what was made of them is written; those that read still depends on stay, and are returned."""
    needed = [unquote(f).removeprefix("file:").lstrip("/") for f in read.inputFiles()] if read is not None else []
    jvm, conf, left = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if any(f.startswith(at.toUri().getPath().lstrip("/") + "/") or f.startswith(path + "/") for f in needed):
            left.append(path)
        else:
            at.getFileSystem(conf).delete(at, True)
    return left


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage: a lost executor costs tasks, not the plan."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    if getattr(_kept, "paths", None) is not None:
        _kept.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose column isn't among wanted (its first column): a bit map of 2 ** LOG2_MARKS hashes, a
    literal of fixed size, keeps them out of a shuffle. None that is wanted is lost."""
    spot = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << LOG2_MARKS) - 1))
    word = lambda c: F.shiftright(c, 5).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(31)).cast("int"))
    marks = [0] * (1 << (LOG2_MARKS - 5))
    spots = wanted.select(spot(F.col(wanted.columns[0])).alias("spot"))
    for i, bits in spots.groupBy(word(F.col("spot")).alias("i")).agg(F.bit_or(bit(F.col("spot")))).collect():
        marks[i] = bits
    known = F.from_json(F.lit(str(marks).replace(" ", "")), "array<long>")
    return rows.where(F.get(known, word(spot(F.col(column)))).bitwiseAND(bit(spot(F.col(column)))) != 0)


def spread_join(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with the columns of known (written, unique by key, with a column rows: how many of rows hold the key), which is dropped.

    The rows of the MOST_HEAVY keys of most rows stay where they are, as that list, of fixed length, is broadcast; the rest is an ordinary join.
    """
    heavy = materialise(known.where(F.col("rows") >= HEAVY_ROWS).orderBy(F.desc("rows"), key).limit(MOST_HEAVY), "heavy-keys")
    keys = F.broadcast(heavy.select(key))
    hot = rows.join(F.broadcast(heavy), key)
    return hot.unionByName(rows.join(keys, key, "left_anti").join(known.join(keys, key, "left_anti"), key)).drop("rows")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def text_key(text: Column) -> Column:
    """64 bits of a text (null differs from empty), the second half of a row's identity."""
    return F.xxhash64(text, text.isNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opened(path: str):
    """The file system of a path and its name there; file://, hdfs://, s3:// and gs:// are known to pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def spread(files: DataFrame, most: int = 100_000) -> DataFrame:
    """A small table with a row a file, dealt to as many tasks; adaptive execution would put small rows into one."""
    return files.repartition(max(1, min(most, files.count())))


def as_rows(docs: DataFrame) -> DataFrame:
    """docs as one column, row, so that no name that an operator adds can clash with one of its."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

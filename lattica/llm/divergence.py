"""Source divergence audit: how far the smoothed term frequencies of the sources of a language are from each other's, exactly.

The distance of two groups is a sum over all kept terms, most of which neither holds. It is taken apart by inclusion and exclusion
over the groups' supports, with p(c) a group's price of a count c:

1. A group's histogram of counts prices its terms as if the other had none of them: ``sum(terms with c * abs(p(c) - other's p(0)))``.
2. Terms that both hold were priced twice, and each time wrongly: a join of the sparse postings corrects these.
3. Terms that neither holds cost the same constant each, ``abs(p(0) - other's p(0))``; how many there are follows from the supports' sizes.

Texts are counted where they are read, in dictionaries of bounded size, so that what is shuffled are counts of terms. From there on
rows are (language, term, source), dealt by (language, term): a source of a third of all rows is spread over its terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import materialise

#: Bytes of terms are ASCII letters, lower-cased, and all beyond ASCII; the others part terms.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Entries of a task's dictionary, after which it is handed on.
ENTRIES = 300_000
SMOOTHING = 5


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), held (documents): partial counts, each (lang, source, term) once for each ENTRIES of a task."""

    def flushed(known: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, held) in known.items():
            keys = list(n)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()), "term": pa.array(part, pa.binary()), "n": pa.array([n[k] for k in part], pa.int64()), "held": pa.array([held[k] for k in part], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                n, held = known.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, mine = len(n), Counter(terms(text.as_py()))
                n.update(mine)
                held.update(mine.keys())
                size += len(n) - before
                if size >= ENTRIES:
                    yield from flushed(known)
                    known, size = {}, 0
        yield from flushed(known)

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, held long")


def price(n: Column, of: Column) -> Column:
    """1 + floor(1000000000 * n / of), by long division in three steps of a thousand, so that longs hold every step for of below 9 * 10 ** 15."""
    div = lambda a, b: F.call_function("div", a, b)
    out, rest = F.lit(1), n
    for unit in (1_000_000, 1000, 1):
        out, rest = out + unit * div(1000 * rest, of), (1000 * rest) % of
    return out


def priced(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, v: kept terms, n_group, size: of these in the group, n_lang, z: the price of a count of 0) and postings (lang, term, source, n, p, z, q), both written."""
    each = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    term = Window.partitionBy("lang", "term")
    kept = each.withColumns({"total": F.sum("n").over(term), "all": F.sum("held").over(term), "first": F.min("source").over(term) == F.col("source")}).where(F.col("all") >= least)
    postings = materialise(kept.select("lang", "term", "source", "n", "total", "first"), "postings")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    mine = postings.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("size"), F.count_if("first").alias("v"))
    sized = groups.join(mine, ["lang", "source"], "left").select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_group", "size", "v")])
    lang = Window.partitionBy("lang")  # a row a group
    told = sized.withColumns({"v": F.sum("v").over(lang), "n_lang": F.sum("n_group").over(lang)})
    stats = materialise(told.withColumn("z", F.when(F.col("v") > 0, price(F.lit(SMOOTHING).cast("long"), F.col("n_group") + SMOOTHING * F.col("v")))), "groups")
    rows = postings.join(stats, ["lang", "source"])
    p, q = (price(F.col(n) + SMOOTHING, F.col(of) + SMOOTHING * F.col("v")) for n, of in (("n", "n_group"), ("total", "n_lang")))
    return stats, materialise(rows.select("lang", "term", "source", "n", p.alias("p"), "z", q.alias("q")), "priced")


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, low, high, value: a row for every two sources of a language, by the three steps above."""
    left, right = (groups.select("lang", *[F.col(c).alias(f"{c}_{side}") for c in ("source", "size", "z")], *["v"][:n]) for side, n in (("a", 1), ("b", 0)))
    pairs = left.join(right, "lang").where("source_a <> source_b")
    none = F.coalesce((F.col("v") - F.col("size_a") - F.col("size_b")) * F.abs(F.col("z_a") - F.col("z_b")), F.lit(0).cast("long"))
    constants = pairs.where("source_a < source_b").select("lang", F.col("source_a").alias("low"), F.col("source_b").alias("high"), none.alias("value"))
    histogram = postings.groupBy("lang", F.col("source").alias("source_a"), "n", "p").agg(F.count(F.lit(1)).alias("terms"))
    alone = histogram.join(pairs.select("lang", "source_a", "source_b", "z_b"), ["lang", "source_a"])
    one_sided = alone.select("lang", F.least("source_a", "source_b").alias("low"), F.greatest("source_a", "source_b").alias("high"), (F.col("terms") * F.abs(F.col("p") - F.col("z_b"))).alias("value"))
    a, b = (postings.select("lang", "term", *[F.col(c).alias(f"{c}_{side}") for c in ("source", "p", "z")]) for side in "ab")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("source_a < source_b")
    overlap = both.select("lang", F.col("source_a").alias("low"), F.col("source_b").alias("high"), (gap("p_a", "p_b") - gap("p_a", "z_b") - gap("p_b", "z_a") + gap("z_a", "z_b")).alias("value"))
    return constants.unionByName(one_sided).unionByName(overlap).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: a row for every ordered pair of sources of a language, and the top terms of each.

    A language keeps the terms that ``least`` of its documents hold. p of a count is 1 + floor(10 ** 9 * (count + 5) / (n + 5 * v)) with n
    the group's occurrences of the v kept terms. Part pair: value is the sum over all kept terms of the two groups' differences of p. Part term:
    the terms of a group whose p is above the whole language's, by how much, of the ``top`` ranks.

    Defined cases: a null text, lang or source is empty; each row is a document, repeated ones too; a group without terms has its pairs, a
    language without kept terms pairs of value 0, one with a single source no pairs; ties rank by the item's bytes; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    groups, postings = priced(docs, least)
    sums = distances(groups, postings)
    sides = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    pair = sums.select("lang", "value", sides.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # the limit by rank is applied in each task before the rows of a group meet
    term = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term).select("lang", "source", "part", "item", "value", "rank")

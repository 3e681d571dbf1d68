"""Quality rules: base counts of a text, and the cross-document frequency of lines.

Lines are normalised (lower case, white space as one space, digits as 0) and hashed. Per host the distinct documents (by
doc_id, whatever their texts) that hold a line are counted, and the host's distinct documents. A line in more documents
than the limit is removed, and a document that is depleted by that is rejected.

DataFrame functions only. All counts of a text are made in its row; what is shuffled are hashes of lines. A line's count
is summed by (host, line, document) and then by (host, line), each with partial sums before the shuffle, so that a line
that a third of all documents hold is spread over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD, as_rows, materialise, text_key, words

SPACE, SYMBOL = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
ROW = ["doc_id", "text_key"]


def windows(hashes: Column, width: int = 5) -> Column:
    """The hashes of all windows of an array of word hashes."""
    n = F.size(hashes)
    spots = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def placed(grams: Column) -> Column:
    """An array's entries with their places, equal ones side by side; null where all are distinct, which is the rule."""
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))


def covered(placed: Column, width: int = 5) -> Column:
    """How many places the entries that occur twice or more cover, each width long. placed has to be a column, not an expression."""
    at = lambda j: F.get(placed, j)["g"]
    twice = F.filter(F.transform(placed, lambda x, j: F.when((x["g"] == at(j - 1)) | (x["g"] == at(j + 1)), x["i"])), lambda i: i.isNotNull())
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sort_array(twice), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")), lambda a: a["n"])


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the base counts of every row."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), body.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counted = rows.withColumns({
        "w": F.transform(words(F.col("text")), lambda w: F.xxhash64(w)),
        "lines": lines,
        "word_chars": (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)).cast("long"),
    })
    grams = counted.withColumns({"grams": windows(F.col("w")), "n_words": F.size("w").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    repeats = F.coalesce(covered(F.col("placed")), F.lit(0).cast("long"))
    return grams.withColumn("placed", placed(F.col("grams"))).withColumn("n_repeat_words", repeats).select(*ROW, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def line_rows(docs: DataFrame) -> DataFrame:
    """A row per line with a word: doc_id, text_key, host, place (in the text, from 0), line (its hash), n (words)."""
    body = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(body), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0"))
    lines = F.filter(F.transform(F.split(plain, " ?\n ?"), lambda line, i: F.struct(line.alias("line"), i.alias("place"))), lambda x: x["line"].rlike(WORD))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("source").alias("host"), lines.alias("lines"))
    # hashed in the explode: of a plain column a filter on its size would be inferred, and the lines made twice
    marks = F.transform("lines", lambda x: F.struct(x["place"].alias("place"), F.xxhash64(x["line"]).alias("line"), F.size(F.split(x["line"], " ")).alias("n")))
    return rows.select(*ROW, "host", F.explode(marks).alias("x")).select(*ROW, "host", "x.*")


def frequent_lines(each: DataFrame, docs: DataFrame, share: float, least: int) -> DataFrame:
    """host, line of the lines that more documents hold than least and than share of the host's; rows that share a doc_id are one document, as are those without."""
    held = each.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    known = docs.select(F.col("source").alias("of_host"), "doc_id").distinct()
    hosts = known.groupBy("of_host").agg(F.count(F.lit(1)).alias("n_host"))
    return held.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("n") > share * F.col("n_host")).select("host", "line")


def judged(docs: DataFrame, share: float, least: int, rest: float) -> DataFrame:
    """What quality_rules gives, and removed_lines, the places of the lines above the limits (null for none)."""
    each = line_rows(docs)
    found = frequent_lines(each, docs, share, least).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    hits = each.join(found, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")), "left_semi")
    gone = hits.select(*ROW, "place", "n").distinct().groupBy(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")).agg(F.sum("n").alias("n_removed_words"), F.collect_list("place").alias("removed_lines"))
    base = materialise(base_counts(docs), "base-counts")  # written: a filter on its result would be pushed into its lambdas, and arrays made anew for every element
    joined = base.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left").drop("g_id", "g_key")
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    left = F.col("n_words") - removed
    depleted = left < rest * F.col("n_words")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), removed.alias("n_removed_words"), "text_key", "removed_lines")


def quality_rules(docs: DataFrame, share: float = 0.1, least: int = 20, rest: float = 0.2) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words, text_key.

    kept is false if the base rules fail (under 10 words, or over 20 % of the words in repeated windows of five) or if,
    without the lines above the limits (in more than ``least`` documents and in more than ``share`` of the host's
    documents), less than ``rest`` of the words are left.

    Defined cases: a null text is empty and fails; a null source is a host of its own; a null doc_id stays null, and all
    rows without one are one document; rows that repeat doc_id and text get the same row; an empty table gives no rows; other columns are ignored.
    """
    return judged(docs, share, least, rest).drop("removed_lines")


def keep_good(docs: DataFrame, share: float = 0.1, least: int = 20, rest: float = 0.2) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps, the texts without the lines above the limits; texts that lose none are unchanged.

    Defined cases: a null text is empty and goes; a null source is a host of its own; a null doc_id stays null, all of them being one document;
    rows that repeat doc_id and text go or stay together; an empty table stays empty; other columns stay, whatever their names.
    """
    good = judged(docs, share, least, rest).where("kept").select(*ROW, "removed_lines").dropDuplicates(ROW)
    rows, text = as_rows(docs), F.col("row.text")
    joined = rows.join(good, F.col("row.doc_id").eqNullSafe(good["doc_id"]) & (text_key(text) == good["text_key"])).withColumn("parts", F.split(text, "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("removed_lines"))
    left = F.array_join(F.transform(keep, lambda i: F.get("parts", i)), "\n")
    new = F.when(F.col("removed_lines").isNull(), text).otherwise(left)
    return joined.select(F.col("row").withField("text", new).alias("row")).select("row.*")

"""Line dedup by an exact set-similarity join.

A line is the set of its words (lower case). Lines of equal sets are one class, found by a grouping with partial results
before the shuffle, so that a line that every document holds is one row a task. Between classes:

* tokens are ordered by rarity: words are counted over all documents in ``2 ** BUCKETS`` hashed counters, a table of fixed
  size, and the coarse logarithm of a word's counter, then its hash, is the order that all lines share;
* prefix filter: sets with a Jaccard similarity of ``t`` share one of their first ``n - ceil(t * n) + 1`` tokens, the rarest;
* length filter, positional filter (what is left behind the shared tokens must reach the overlap that is needed) and a
  parity filter (each differing token flips one of 64 bits, of 128 or 256 for longer lines, as few bits fill up and let
  pairs through whose number grows with the square of the input) are conditions of that join;
* postings of very frequent tokens are parted by the logarithm of their line's length, as similar lines are nearly as long;
* what remains is verified on the words of the texts themselves, as 64-bit hashes, and no more of it than is needed to know
  whether a line has an earlier one: variants of one line aren't all paired with each other.

A line's position, one number in the order of (doc_id, line), stands for it wherever only order and identity are asked; a
class is named by the position of its first line. A line goes if its class occurs earlier, or a similar class's first line
is earlier. All lines are judged on the input. DataFrame functions only.
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import WORD, as_rows, marked, materialise, spread_join, text_key, words

BUCKETS, LONG, LONGER = 15, 48, 112
#: Quarter-logarithm of the occurrences from which a token's postings are parted by length.
FREQUENT = 4 * 22
ROW = ["doc_id", "text_key"]


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKETS).cast("int")


def levels_of(hashes: DataFrame) -> Column:
    """For each hashed counter the quarter-logarithm of the occurrences (column h), in the high bits, as a literal array: 2 ** BUCKETS numbers, whatever the input."""
    counts = hashes.groupBy(bucket(F.col("h")).alias("b")).agg(F.floor(4 * F.log2(F.count(F.lit(1)) + 1)).cast("int").alias("level"))
    out = [0] * (1 << BUCKETS)
    for b, level in counts.collect():
        out[b] = min(level, 126) << 56
    return F.from_json(F.lit(str(out).replace(" ", "")), "array<bigint>")  # folded into a literal


def ordered(hashes: Column, level: Column) -> Column:
    """Distinct hashes as tokens, rarest first: a level in the high bits, a hash below."""
    return F.sort_array(F.transform(hashes, lambda h: F.get(level, bucket(h)).bitwiseOR(F.shiftrightunsigned(h, 8))))


def prefix(t: Column, similarity: float) -> Column:
    """The prefix of ordered tokens as 31 bits each; the sign marks frequent ones. The lowest bits are left to the parity."""
    n = F.size(t)
    low = lambda x: F.shiftright(x, 8).bitwiseAND(F.lit((1 << 31) - 1))
    small = lambda x: F.when(x >= F.lit(FREQUENT << 56), -1 - low(x)).otherwise(low(x)).cast("int")
    return F.transform(F.slice(t, F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")), small)


class Positions(NamedTuple):
    """How (doc_id, text, line) becomes one number: a long where the ids' span and the longest text leave room and no id has two texts, else a decimal."""

    low: int
    bits: int
    wide: bool

    def of(self, doc_id: Column, key: Column, place: Column) -> Column:
        """A null doc_id comes before any other; rows that share an id are told apart by 31 bits of their text's hash."""
        if not self.wide:
            return F.shiftleft(F.coalesce(doc_id.cast("long") - F.lit(self.low) + 1, F.lit(0).cast("long")), self.bits).bitwiseOR(place.cast("long"))
        whole = lambda c: c.cast("decimal(20,0)")
        two31 = F.lit(1 << 31).cast("decimal(10,0)")
        of_text = whole(F.coalesce(doc_id.cast("long").cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)"))) * two31 + key.bitwiseAND(F.lit((1 << 31) - 1)).cast("decimal(10,0)")
        return (of_text * two31 + place.cast("decimal(10,0)")).cast("decimal(38,0)")


def positions(docs: DataFrame) -> Positions:
    low, high, most, n = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.max(F.octet_length("text")), F.count(F.lit(1))).first()
    low, high, bits = low or 0, high or 0, max(1, (most or 0).bit_length())
    shared = docs.select("doc_id").distinct().count() < n
    if shared:  # by copies of rows, or by different texts
        rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key")).distinct()
        shared = rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return Positions(low, bits, shared or (high - low + 2).bit_length() + bits > 62)


def lines_of(docs: DataFrame, similarity: float, at: Positions) -> DataFrame:
    """A row per line with a word: doc_id, text_key, place, pos, id (of its class), n (tokens), parity (1, 2 or 4 words of 64 bits), prefix."""
    level = levels_of(docs.select(F.explode(words(F.lower("text"))).alias("w")).select(F.xxhash64("w").alias("h")))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(F.split(F.lower("text"), "\n")).alias("place", "line")).where(F.col("line").rlike(WORD))
    hashes = F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)))
    sets = rows.select(*ROW, "place", at.of(F.col("doc_id"), F.col("text_key"), F.col("place")).alias("pos"), ordered(hashes, level).alias("t"))
    n, bit = F.size("t"), lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    flipped = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))
    part = lambda k, of: flipped(F.filter("t", lambda t: t.bitwiseAND(F.lit(64 * (of - 1))) == 64 * k))
    parity = F.when(n <= LONG, F.array(flipped("t"))).when(n <= LONGER, F.array(*[part(k, 2) for k in range(2)])).otherwise(F.array(*[part(k, 4) for k in range(4)]))
    return sets.select(*ROW, "place", "pos", F.xxhash64("t").alias("id"), n.alias("n"), parity.alias("parity"), prefix(F.col("t"), similarity).alias("prefix"))


def postings(classes: DataFrame, similarity: float, frequent: bool) -> DataFrame:
    """A row per token of a prefix (id, n, parity, prefix of classes) that is, or isn't, frequent: token, slot, span (n and the token's place), p0 to p3 (parity), id.

    slot, of frequent tokens only, is the number of the span of lengths, in two rows, so that lengths within the similarity share one.
    parity has 1, 2 or 4 words. p0 and p1 are its folds to two words, and p0 all of it if it has one; p2 and p3 are the last two of four.
    """
    p, two = lambda k: F.get("parity", k), F.size("parity") == 4
    each = [F.when(two, p(k).bitwiseXOR(p(k + 2))).otherwise(p(k)).alias(f"p{k}") for k in range(2)] + [p(k).alias(f"p{k}") for k in (2, 3)]
    posts = classes.select(F.posexplode("prefix").alias("at", "token"), "n", *each, "id").where(F.col("token") < 0 if frequent else F.col("token") >= 0)
    width = F.floor(F.log("n") / -math.log(similarity) + 1e-9).cast("int") if similarity < 1 else F.col("n")
    slot = [F.explode(F.array(width + 1, width + 2)).alias("slot")] if frequent else []
    return posts.select("token", *slot, F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("span"), "p0", "p1", "p2", "p3", "id")


def passing(similarity: float) -> Column:
    """Whether a posting x and a posting y of one token pass the filters."""
    n, at = lambda c: F.shiftright(f"{c}.span", 32), lambda c: F.col(f"{c}.span").bitwiseAND(F.lit((1 << 32) - 1))
    overlap = F.ceil(similarity / (1 + similarity) * (n("x") + n("y")) - 1e-9)
    length = F.least(n("x"), n("y")) >= similarity * F.greatest(n("x"), n("y")) - 1e-9
    behind = 1 + F.least(at("x"), at("y")) + F.least(n("x") - at("x") - 1, n("y") - at("y") - 1)
    most = n("x") + n("y") - 2 * overlap
    p, none = lambda c, k: F.col(f"{c}.p{k}"), F.lit(0).cast("long")
    one = lambda c: p(c, 0).bitwiseXOR(F.coalesce(p(c, 1), none))
    bits = lambda k: F.bit_count(p("x", k).bitwiseXOR(p("y", k)))  # noqa: E731  null unless both have it
    high = lambda k: F.bit_count(p("x", k).bitwiseXOR(p("x", k + 2)).bitwiseXOR(p("y", k)).bitwiseXOR(p("y", k + 2)))
    differ = F.coalesce(high(0) + high(1) + bits(2) + bits(3), bits(0) + bits(1), F.bit_count(one("x").bitwiseXOR(one("y")))) <= most
    # cheap and rejecting nearly all pairs, so first: the first words alone, where both have as many, differ in no more bits than a share of both sizes
    first = (F.bit_count(p("x", 0).bitwiseXOR(p("y", 0))) * (1 + similarity) <= (n("x") + n("y")) * (1 - similarity) + 1e-6) | (p("x", 1).isNull() != p("y", 1).isNull())
    return (F.col("x.token") == F.col("y.token")) & (F.col("x.id") != F.col("y.id")) & first & length & (behind >= overlap) & differ


def involved(classes: DataFrame, similarity: float) -> DataFrame:
    """The postings that pass the filters with another: a semi-join, which gives each at most once however many it passes with."""

    rare, frequent = postings(classes, similarity, False), postings(classes, similarity, True)
    # under aliases, not new names, and without a column that the condition doesn't need: then both sides are one shuffle
    one = rare.alias("x").join(rare.alias("y"), passing(similarity), "left_semi").select("x.*").withColumn("slot", F.lit(0))
    two = frequent.alias("x").join(frequent.alias("y"), passing(similarity) & (F.col("x.slot") == F.col("y.slot")), "left_semi").select("x.*")
    return one.unionByName(two)


def earlier(xs: DataFrame, ys: DataFrame, similarity: float, order: str) -> DataFrame:
    """a, b: ids of pairs that pass the filters, a before b by the column order."""
    found = xs.alias("x").join(ys.alias("y"), passing(similarity) & (F.col("x.slot") == F.col("y.slot")) & (F.col(f"x.{order}") < F.col(f"y.{order}")))
    return found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def line_words(ids: DataFrame, docs: DataFrame, at: Positions) -> DataFrame:
    """id, w: the distinct words, hashed, of the lines at positions ids, from the texts themselves. Lines are shuffled, not texts."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(F.split(F.lower("text"), "\n")).alias("place", "line"))
    lines = rows.select(at.of(F.col("doc_id"), F.col("text_key"), F.col("place")).alias("pos"), "line")
    held = marked(lines, "pos", ids).join(ids.select(F.col("id").alias("pos")), "pos").dropDuplicates(["pos"])
    return held.select(F.col("pos").alias("id"), F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w))).alias("w"))


def verified(pairs: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """id of the classes b that have the similarity with their a in words."""
    a, b = each.select(F.col("id").alias("a"), F.col("w").alias("wa")), each.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    return both.where(F.col("shared") >= similarity * (F.size("wa") + F.size("wb") - F.col("shared")) - 1e-9).select(F.col("b").alias("id")).distinct()


def late_ids(posts: DataFrame, each: DataFrame, similarity: float, order: str, leaders: int = 2) -> DataFrame:
    """id of the classes that come, by the column order, after a similar class; posts: what involved gives, each: their words.

    Whether there is one is asked, not which: each class meets the earliest classes of its tokens first, so that of a large
    group of variants of one line most are settled by few pairs each. Only those that are left meet all earlier ones.
    """
    first = posts.withColumn("r", F.row_number().over(Window.partitionBy("token", "slot").orderBy(order, "id"))).where(F.col("r") <= leaders).drop("r")
    tried = materialise(earlier(first, posts, similarity, order), "set-pairs")
    late = materialise(verified(tried, each, similarity), "late-sets")
    rest = earlier(posts, posts.join(late, "id", "left_anti"), similarity, order).join(tried, ["a", "b"], "left_anti")
    return late.unionByName(verified(rest, each, similarity))


def gone_lines(lines: DataFrame, docs: DataFrame, similarity: float, at: Positions) -> DataFrame:
    """doc_id, text_key, place, repeated (its words occur in an earlier line) and similar (it is its class's first line and an earlier one is similar) of the lines that go."""
    grouped = lines.groupBy("id", "n", "parity", "prefix").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(grouped, "line-classes")
    posts = materialise(involved(classes.drop("id").withColumnRenamed("first", "id"), similarity), "line-postings")
    each = materialise(line_words(posts.select("id").distinct(), docs, at), "line-words")
    late = late_ids(posts, each, similarity, "id").select(F.col("id").alias("first"), F.lit(True).alias("late"))
    known = classes.select("id", "first", "rows").join(late, "first", "left").where("rows > 1 OR late").select("id", "first", "rows", F.coalesce("late", F.lit(False)).alias("late"))
    known = materialise(known, "known-lines")
    told = spread_join(lines.select(*ROW, "place", "pos", "id"), known, "id")
    own = F.col("pos") == F.col("first")
    return told.where(~own | F.col("late")).select(*ROW, "place", (~own).alias("repeated"), (own & F.col("late")).alias("similar"))


def line_dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), n_repeated, n_similar, removed_lines (their numbers from 0), text_key.

    Defined cases: a null text has no lines; lines without a word are never removed; a null doc_id is earlier than any
    other; rows that repeat doc_id and text get one verdict; of rows that share a doc_id and differ in text one comes first, by a hash;
    sets of equal words are equal lines whatever their order; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    at = positions(docs)
    lines = materialise(lines_of(docs, similarity, at), "lines")
    gone = gone_lines(lines, docs, similarity, at).dropDuplicates([*ROW, "place"])
    by = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")).agg(F.count_if("repeated").alias("n_repeated"), F.count_if("similar").alias("n_similar"), F.sort_array(F.collect_list("place")).alias("gone"))
    n_lines = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*"))  # from a line's first word to its end
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"))
    joined = rows.join(by, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    none = F.lit(0).cast("long")
    return joined.select("doc_id", "n_lines", *[F.coalesce(c, none).alias(c) for c in ("n_repeated", "n_similar")], F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"), "text_key")


def remove_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with all its columns, the text without the removed lines; texts that lose none are unchanged.

    Defined cases: a null text stays null; a text of which all lines go becomes empty; a null doc_id and rows that repeat doc_id and text are
    judged as in line_dedup; an empty table gives no rows; other columns stay, whatever their names.
    """
    gone, rows = line_dedup(docs, similarity).where("n_repeated + n_similar > 0").dropDuplicates(ROW).select(*ROW, "removed_lines"), as_rows(docs)
    text = F.col("row.text")
    joined = rows.join(gone, F.col("row.doc_id").eqNullSafe(gone["doc_id"]) & (text_key(text) == gone["text_key"]), "left").withColumn("parts", F.split(text, "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("removed_lines"))
    left = F.array_join(F.transform(keep, lambda i: F.get("parts", i)), "\n")
    new = F.when(F.col("removed_lines").isNull(), text).otherwise(left)
    return joined.select(F.col("row").withField("text", new).alias("row")).select("row.*")

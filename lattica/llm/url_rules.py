"""URL filters: a list of rules for hosts and paths, and behind it rules mined from labelled URLs.

A URL is a set of tokens (scheme, host, each suffix of the host, path segments with digits as #, extension, query keys).
FP-growth mines the token sets of at most ``longest`` tokens that are frequent among the URLs labelled bad. Tokens that occur
in the same labelled URLs are one, the first of them by name. The sets of n tokens within one URL number ``2 ** n``, so a
URL of more frequent tokens than ``basket`` gives several baskets: its tokens are cut into ``longest`` times as many groups as
fit, and each ``longest`` of these groups are a basket, so that every set that may be a rule is whole in one. That counts some sets
too often, never too rarely: support and confidence of every set found are then counted over all labelled URLs with all
their tokens. Of the association rules (set -> bad) those stay that have the support, the confidence, a lower 99 % bound
of it above the labels' own share of bad by a margin, and no shorter rule within them of at least their confidence.

A URL is matched by an inverted index: it meets a rule at the rule's rarest token, and the rule fires if the URL has the
rule's other tokens too.

DataFrame functions and Spark's own FP-growth only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialise, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path), the list that the query is to apply.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
RULE = "rule_id long, tokens array<string>, rarest string, n long, n_bad long, confidence double"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<length, rule, verdict>; null if none does. A rule fits its host and all subdomains."""
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    fit = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(none, *fit))


def url_tokens(url: Column) -> Column:
    host, path = host_and_path(url)
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "#")))
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.substring_index(s, "=", 1)))
    extension = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    rest = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "^([A-Za-z]*)://", 1)), F.concat(F.lit("extension:"), extension))
    return F.array_distinct(F.concat(rest, suffixes, segments, keys))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (column url_tokens and others) with each rule (rule_id) whose tokens they all have, by the index of the rules' rarest tokens."""
    index = rules.select("rule_id", "tokens", "rarest")
    met = urls.select("*", F.explode("url_tokens").alias("token")).join(index, F.col("token") == F.col("rarest"))
    return met.where(F.size(F.array_except("tokens", "url_tokens")) == 0).drop("token", "rarest", "tokens", "url_tokens")


def lower_bound(k: Column, n: Column, z: float = 2.58) -> Column:
    """Wilson's lower bound of a share."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def split_baskets(items: Column, longest: int, basket: int) -> Column:
    """Arrays of at most ``basket`` tokens that between them hold every set of at most ``longest`` of the array items whole."""
    size = basket // longest
    groups = F.transform(F.sequence(F.lit(0), F.ceil((F.size(items) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, size))

    def chosen(n: int, after: Column) -> Column:
        """Unions of n groups behind a place."""
        rest = F.when(after < F.size(groups), F.sequence(after, F.size(groups) - 1)).otherwise(F.array().cast("array<int>"))
        if n == 1:
            return F.transform(rest, lambda i: F.get(groups, i))
        return F.flatten(F.transform(rest, lambda i: F.transform(chosen(n - 1, i + 1), lambda tail: F.concat(F.get(groups, i), tail))))

    return F.when(F.size(items) <= basket, F.array(items)).otherwise(chosen(longest, F.lit(0)))


def mined_rules(labelled: DataFrame, support: float = 0.004, confidence: float = 0.8, least: int = 10, margin: float = 0.1, longest: int = 3, basket: int = 12) -> DataFrame:
    """The pruned rules of at most ``longest`` tokens; labelled: url, bad (boolean, null counts as false).

    rule_id, tokens (sorted), rarest (of its tokens), n and n_bad (labelled rows that have them all), confidence. A rule has
    at least ``least`` bad rows and ``support`` of all labelled rows, and a token in it at least as many, so that there are
    at most (tokens of a URL) / ``support`` such tokens. Rows with a null url are left out. ``basket`` (at least ``longest``) decides on the
    work only: FP-growth finds at most 2 ** basket sets in a basket, and a URL of n frequent tokens gives about (n * longest / basket) ** longest / 6 of them.
    """
    spark = labelled.sparkSession
    urls = labelled.where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("bad", F.lit(False))).alias("n_bad"))
    # a number of parts of its own: the table is small and what is counted over it is not, so that its size mustn't decide on the tasks
    dealt = urls.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "url")
    urls = materialise(dealt.withColumn("url_tokens", url_tokens(F.col("url"))), "labelled-urls")
    total, bad = urls.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    floor = max(least, math.ceil(support * total - 1e-9))
    if bad < floor:
        return spark.createDataFrame([], RULE)
    each = urls.select("url", "n", "n_bad", F.explode("url_tokens").alias("token"))
    # tokens of the same URLs: as many, and the same sums of two hashes
    marks = [F.sum(F.xxhash64("url", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2)]
    known = each.groupBy("token").agg(F.sum("n").alias("t_n"), F.sum("n_bad").alias("t_bad"), *marks).where(F.col("t_bad") >= floor)
    known = materialise(known, "url-tokens")
    single = known.groupBy("t_n", "t_bad", "m1", "m2").agg(F.min("token").alias("token")).select("token")
    picked = each.where("n_bad > 0").join(single, "token").groupBy("url").agg(F.first("n_bad").alias("n_bad"), F.sort_array(F.collect_list("token")).alias("items"))
    split = picked.select("n_bad", F.explode(split_baskets(F.col("items"), longest, basket)).alias("items"))
    baskets = materialise(split.select("items", F.explode(F.sequence(F.lit(1).cast("long"), "n_bad"))).select("items"), "url-baskets")
    tasks = spark.sparkContext.defaultParallelism
    sets = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / max(1, baskets.count()), numPartitions=tasks).fit(baskets.repartition(tasks)).freqItemsets
    sets = sets.where(F.size("items") <= longest).select(F.sort_array("items").alias("tokens")).withColumn("rule_id", F.xxhash64("tokens"))
    rarest = sets.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(known, "token").groupBy("rule_id", "tokens").agg(F.min_by("token", F.struct("t_n", "token")).alias("rarest"))
    rarest = materialise(rarest, "url-sets")
    counted = matches(urls.select("n", "n_bad", "url_tokens"), rarest).groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    sure = (F.col("n_bad") >= floor) & (F.col("n_bad") >= confidence * F.col("n")) & (lower_bound(F.col("n_bad"), F.col("n")) >= bad / total + margin)
    found = materialise(rarest.join(counted.where(sure), "rule_id").select("rule_id", "tokens", "rarest", "n", "n_bad", (F.col("n_bad") / F.col("n")).alias("confidence")), "url-rules")
    # a rule within a rule: the longer one has the shorter one's rarest token, so they meet in the index
    long = found.select(F.col("rule_id").alias("long_id"), F.col("tokens").alias("url_tokens"), F.col("confidence").alias("long_confidence"))
    within = matches(long, found).join(found.select("rule_id", "confidence"), "rule_id").where((F.col("rule_id") != F.col("long_id")) & (F.col("confidence") >= F.col("long_confidence")))
    return found.join(within.select(F.col("long_id").alias("rule_id")).distinct(), "rule_id", "left_anti")


def fired(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url_key of the pages for which a rule fires, each once; a null url has the tokens of nothing, a null page_id stays null, no rules fire for none."""
    urls = pages.select("page_id", text_key(F.col("url")).alias("url_key"), url_tokens(F.col("url")).alias("url_tokens"))
    return matches(urls, rules).select("page_id", "url_key").distinct()


def held_out(labelled: DataFrame, parts: int = 5, **parameters) -> tuple[int, int, int, int]:
    """Rules mined without every parts-th URL (by hash), applied to those: rows, bad rows, rows for which a rule fires, bad ones of these."""
    part = F.pmod(F.xxhash64("url"), F.lit(parts))
    test = labelled.where(part == 0).select("url", F.coalesce("bad", F.lit(False)).alias("bad"))
    rules = mined_rules(labelled.where(part != 0), **parameters)
    hits = fired(test.select(F.lit(0).alias("page_id"), "url"), rules).select(F.col("url_key").alias("f_key"), F.lit(True).alias("hit"))
    told = test.join(hits, text_key(F.col("url")) == F.col("f_key"), "left")
    return tuple(told.agg(F.count(F.lit(1)), F.count_if("bad"), F.count_if(F.coalesce("hit", F.lit(False))), F.count_if(F.col("bad") & F.coalesce("hit", F.lit(False)))).first())


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad of the pages whose URL names a labelled document. Bad is what is of no quality or toxic.

    An assumption, as labels are of documents and no table ties pages to these: the first number that starts a path segment is a doc_id.
    Defined cases: a null url, one without such a number or with one that no label has gives no row; of a doc_id with several labels one that
    is bad decides; labels that are null are not bad.
    """
    _, path = host_and_path(F.col("url"))
    of = pages.select("url", F.regexp_extract(path, r"/(\d{1,18})", 1).alias("x")).selectExpr("url", "try_cast(x as long) doc_id")
    judged = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return of.join(judged, "doc_id").select("url", "bad")


def url_verdicts(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **parameters) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict (the listed rule's, else block if a mined rule fires, else allow), mined (whether one fires).

    Defined cases: a null url or one without ``://`` has an empty host and path, fits no listed rule, and its tokens are those of
    nothing; a null page_id stays null and is judged by its url; rows that repeat page_id and url get one verdict; without
    labelled rows, or with too few, nothing is mined; other columns are ignored. parameters are those of mined_rules.
    """
    host, path = host_and_path(F.col("url"))
    hits = fired(pages, mined_rules(labelled, **parameters)).select(F.col("page_id").alias("f_id"), F.col("url_key").alias("f_key"), F.lit(True).alias("hit"))
    rows = pages.select("page_id", text_key(F.col("url")).alias("url_key"), host.alias("host"), path.alias("path"))
    joined = rows.join(hits, F.col("page_id").eqNullSafe(F.col("f_id")) & (F.col("url_key") == F.col("f_key")), "left")
    mined = F.coalesce("hit", F.lit(False))
    told = joined.withColumn("best", listed(F.col("host"), F.col("path"), rules))
    return told.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(mined, "block").otherwise("allow")).alias("verdict"), mined.alias("mined"))

"""Source divergence, vector codes and language identification against plain loops, on the given tables and on defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, divergence, language_id, queries, vector_codes

from .test_contracts import SF, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(docs, least=30, top=50):
    """docs: (text, lang, source)."""
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in held[lang].items() if n >= least}
        counts = {s: {t: n for t, n in c.items() if t in kept} for (g, s), c in groups.items() if g == lang}
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def price(c, t):
            return 1 + 1_000_000_000 * (c.get(t, 0) + 5) // (sum(c.values()) + 5 * len(kept))

        prices = {s: {t: price(c, t) for t in kept} for s, c in counts.items()}
        q = {t: price(whole, t) for t in kept}
        for s, c in counts.items():
            parts = {
                "pair": [(sum(abs(prices[s][t] - prices[o][t]) for t in kept), o) for o in counts if o != s],
                "term": [(prices[s][t] - q[t], t) for t in kept if c.get(t, 0) and prices[s][t] > q[t]],
            }
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_of_the_table(spark):
    docs = [tuple(r) for r in common.table(spark, SF, "documents").select("text", "lang", "source").collect()]
    got = queries.op11_divergence(spark, SF)
    assert rows(got, *COLUMNS) == brute_divergence(docs) and got.count() == len(brute_divergence(docs))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_divergence_cases(spark):
    """Nulls, groups without terms, languages without kept terms, one source alone, ties, non-ASCII terms, a long text, clashing columns."""
    docs = [
        ("a B c a", "x", "s"), ("a c Straße ÄÖ", "x", "t"), ("A-c_1a É é", "x", None), (None, "x", "u"), ("", "x", "s"), ("b z", "x", "t"), ("b a", "x", "t"), ("b a", "x", "t"),
        ("q", "y", "s"), ("w", "y", "t"), ("a a a", None, "s"), ("a b", None, None), ("a", None, "s"), ("only one", "v", "s"), ("only one", "v", "s"), ("lorem " * 200_000 + "a", "x", "é"), ("lorem", "x", "z"),
    ]
    schema = "text string, lang string, source string, term string, n int, z long, item string, value string, rank int"
    df = spark.createDataFrame([(*d, "t", 1, 2, "i", "v", 3) for d in docs], schema)
    for least, top in ((2, 2), (1, 50), (30, 50)):
        got = divergence.divergence(df, least, top)
        assert rows(got, *COLUMNS) == brute_divergence(docs, least, top) and got.count() == len(brute_divergence(docs, least, top))
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_hands_on_full_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    docs = [(f"a{'xyz'[i % 3]} b c{'xyz'[i % 2]}", "l", f"s{i % 4}") for i in range(60)]
    got = divergence.divergence(spark.createDataFrame(docs, "text string, lang string, source string"), 10)
    assert rows(got, *COLUMNS) == brute_divergence(docs, 10)


def test_price_is_exact(spark):
    cases = [(5, 7), (10**9 + 7, 3 * 10**9 + 1), (8 * 10**15 - 1, 8 * 10**15), (1, 8 * 10**15), (6, 6)]
    df = spark.createDataFrame(cases, "n long, of long")
    assert [r[0] for r in df.select(divergence.price(F.col("n"), F.col("of"))).collect()] == [1 + 10**9 * n // of for n, of in cases]


def brute_codes(vectors, rounds=4):
    """vectors: (id, components, label). One row of equal ids at most."""
    kept = [(i, v, label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return set()
    width = -(-max(len(v) for _, v, _ in kept) // 4)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (4 * width - len(v)) for _, v, _ in kept]
    cut = [[w[p * width : (p + 1) * width] for w in whole] for p in range(4)]
    first = sorted(range(len(kept)), key=lambda k: kept[k][0])[:256]
    books = [[cut[p][k] for k in first] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])) for x in cut[p]]

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for x, (_, e) in zip(cut[p], assign(p)):
                members[e].append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    found = [assign(p) for p in range(4)]
    error = [sum(found[p][k][0] for p in range(4)) for k in range(len(kept))]
    by = Counter()
    for (_, _, label), e in zip(kept, error):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {(i, "".join(f"{found[p][k][1]:02x}" for p in range(4)), error[k], by[label], digest) for k, (i, _, label) in enumerate(kept)}


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_codes_of_the_table(spark, con):
    want = con.sql(queries.ORACLES["op12_vector_codes"])
    names = want.columns
    assert rows(queries.op12_vector_codes(spark, SF), *CODES) == {tuple(r[names.index(c)] for c in CODES) for r in want.fetchall()}


@pytest.mark.parametrize("n,width", [(40, 8), (300, 4), (5, 0), (30, 7)])
def test_codes_cases(spark, n, width):
    """Nulls, non-finite and missing components, shorter vectors, ties by repeated vectors, null labels, fewer vectors than entries, clashing columns."""
    r = np.random.default_rng(n)
    vectors = [(int(i) * 3 - 20, [float(np.float32(x)) for x in r.normal(0, 0.3, width)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]
    vectors += [(1000, None, 1), (-1000, [float("nan")] * width, 1), (-1001, [None] * width, None), (-1002, [float("inf")] + [0.0] * (width - 1), 2)] if width else [(1000, None, 1)]
    if width:
        vectors += [(2000, vectors[3][1], 7), (2001, vectors[3][1][: width // 2], None), (-500, [], 7)]
    r.shuffle(vectors)
    df = spark.createDataFrame([(*v, "x", 1, "y", 2) for v in vectors], "vec_id long, embedding array<float>, label int, id string, code int, rows string, data int")
    got = vector_codes.vector_codes(df.repartition(3))
    assert rows(got, *CODES) == brute_codes(vectors) and got.count() == len(brute_codes(vectors))


def test_codes_of_nothing_repeats_and_large_components(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    twice = spark.createDataFrame([(1, [0.5, 0.25, 0.0, 1.0], ""), (1, [0.5, 0.25, 0.0, 1.0], None), (None, [0.0, 0.0, 0.0, 0.0], "x")], schema)
    got = vector_codes.vector_codes(twice).collect()
    assert sorted((r["vec_id"] or 0, r["code"]) for r in got) == [(0, "00000000"), (1, "00000000"), (1, "00000000")]
    assert len({r["label_error"] for r in got if r["vec_id"] is None}) == 1
    huge = [(1, [1e300, -1e300, 3e5, 0.0], "a"), (2, [0.0] * 4, "a"), (3, [-1e300, 1e300, 0.0, 0.0], "b")]
    assert all(r["error"] >= 0 for r in vector_codes.vector_codes(spark.createDataFrame(huge, schema)).collect())


def test_nearest_takes_the_first_of_ties_in_both_widths():
    for scale in (1, 10**6):
        data, entries = np.array([[0, 4, 9]]) * scale, np.array([[2], [-2], [2], [8]]) * scale
        code, error = vector_codes.nearest(data, entries)
        assert code.tolist() == [0, 0, 3] and error.tolist() == [4 * scale**2, 4 * scale**2, scale**2]


def plain_words(text):
    return Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))


def brute_language(docs, most=40_000, smoothing=0.5):
    """docs: (id, text, lang), texts without numerals that are no digits."""
    kinds, counts = (0, 4, 3, 2, 1), defaultdict(Counter)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}

    def parts(word, size):
        if size == 0:
            return [word] if len(word) <= 40 else []
        padded = word if size == 1 else f" {word} "
        return [padded[i : i + size] for i in range(len(padded) - size + 1)]

    for i, text, lang in docs:
        if lang is not None and not held[i]:
            for w, n in plain_words(text).items():
                for size in kinds:
                    for g in parts(w, size):
                        counts[size, g][lang] += n
    langs = sorted({x for c in counts.values() for x in c})
    total, known = Counter(), set()
    for (size, _), c in counts.items():
        for lang, n in c.items():
            total[size, lang] += n
    for size in kinds:
        known |= set(sorted((k for k in counts if k[0] == size), key=lambda k: (-sum(counts[k].values()), k[1].encode()))[:most])

    def value(k):
        return [math.log((counts[k][x] + smoothing) / (total[k[0], x] + smoothing)) for x in langs]

    out = {}
    for i, text, _ in docs:
        score, seen = [0.0] * len(langs), False
        found = plain_words(text)
        for w, n in found.items():
            for size in kinds:
                hits = [value((size, g)) for g in parts(w, size) if (size, g) in known]
                if hits:
                    score = [s + n * sum(h[j] for h in hits) / len(hits) for j, s in enumerate(score)]
                    seen = True
                    break
        if not found:
            out[i] = (held[i], "und", 0.0)
        elif seen:
            share = [math.exp(s - max(score)) for s in score]
            out[i] = (held[i], langs[score.index(max(score))], max(share) / sum(share))
    return out


def test_language_of_the_table(spark):
    """Against the loop, and right for what was held out."""
    docs = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in queries.op13_language_id(spark, SF).collect()}
    want = brute_language(docs)
    assert set(got) == {d[0] for d in docs} and set(want) == set(got)
    for i, (held, lang, score) in want.items():
        assert got[i]["held_out"] == held and got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-3
    out = [(got[i]["lang_pred"], lang) for i, text, lang in docs if got[i]["held_out"] and lang is not None and plain_words(text)]
    assert len(out) > 30 and sum(a == b for a, b in out) >= 0.97 * len(out)


def test_language_falls_back_to_shorter_grams(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the thing thinks", "en"), ("der ding denkt", "de"), ("это слово", "ru")] * 8)]
    asked = [(100 + i, t, None) for i, t in enumerate(["thinking", "dingen", "словом", "qqq thing", "THE 123", "٣٤٥", "", None, "½ ² Ⅷ", "漢字", "th" * 50_000, "о" * 41])]
    df = spark.createDataFrame([(*d, 1, "z", 2) for d in docs + asked + [(None, "the thing", "xx"), (None, None, None)]], "doc_id long, text string, lang string, size int, gram string, n int")
    got = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    said = [got[100 + i]["lang_pred"] for i in range(len(asked))]
    assert said == ["en", "de", "ru", "en", "en", "und", "und", "und", "und", said[9], "en", "ru"] and said[9] in {"en", "de", "ru"}
    assert got[None]["held_out"] and all(r["lang_pred"] != "xx" and 0 <= r["score"] <= 1 for r in got.values())
    small = language_id.language_id(df, most=5, most_words=3)
    assert small.count() == df.count() and {r["lang_pred"] for r in small.collect()} <= {"en", "de", "ru", "und"}


def test_language_of_more_unknown_words_than_are_remembered():
    model = language_id.Model(["de", "en"], {0: {"the": 0}, 4: {}, 3: {}, 2: {}, 1: {c: 1 + i for i, c in enumerate("abcdef")}}, -np.arange(14, dtype=np.float32).reshape(7, 2) / 7 - 0.01, 0)
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("abcdef "), 3000)) + " the zz" for _ in range(4)]
    full, small = language_id.Judge(model), language_id.Judge(model)
    small.most = 5
    for text in texts:
        total = np.zeros(2)
        for w, n in language_id.words(text).items():
            there, values = language_id.backoff(model, [w])
            total = total + n * (model.scores[0] if w == "the" else values[0] if len(there) else 0)
        want = ("de", "en")[int(total.argmax())]
        assert full.verdict(text)[0] == small.verdict(text)[0] == want and full.verdict(text)[1] == pytest.approx(small.verdict(text)[1], abs=1e-5) and len(small.known) <= 6


def test_language_never_sees_the_lang_it_predicts(spark):
    """Other values of lang, source and n_chars where documents are held out change nothing."""
    docs = common.table(spark, SF, "documents")
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    columns = ("doc_id", "lang_pred", "score")
    assert rows(language_id.language_id(docs), *columns) == rows(language_id.language_id(other), *columns)


def test_language_with_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.language_id(empty).count() == 0
    one = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.language_id(one).collect()} == {("und", 0.0)}

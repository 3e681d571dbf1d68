"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import gzip
import math
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lattica.llm import bpe, common, exact_dedup, line_dedup, memo_tokenizer, packing, quality, simhash, substring_dedup, token_file, url_rules, warc

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text_key string, kept int, fp string, cut string, removed_lines string, doc string"
EXTRA = ("x",) * 2 + (7,) + ("y",) * 4


def words(seed, n, k=400):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=4)) for _ in range(n)) if k == 400 else " ".join(f"w{r.randrange(k)}" for _ in range(n))


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None, *EXTRA)


@pytest.fixture(scope="module")
def texts():
    long, passage = words(1, 60_000), words(2, 60)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One line here.\nOne line here.\nAnother line, quite another."), (5, long), (6, long), (7, f"{words(3, 80)}\n{passage}"), (8, f"{words(4, 70)} {passage} end"),
        (9, passage), (9, passage), (None, passage), (None, None), (10, "A B  C\nd"), (11, "A B C d"), (12, "x" * 5000), (13, words(5, 300)), (14, words(5, 300).replace(" ", "  ", 3)), (-3, passage + " more"), (15, "a b c d e " * 30),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([row(d, t, None if d == 7 else "s") for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


FUNCTIONS = {
    "exact": exact_dedup.exact_dedup, "bpe": bpe.bpe_round_trip, "simhash": simhash.simhash_components, "quality": quality.quality_rules, "lines": line_dedup.line_dedup, "tokens": token_file.token_files,
    "remove_lines": line_dedup.remove_lines, "substring": substring_dedup.substring_dedup,
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_every_row_once_and_empty_tables(name, docs, empty, texts):
    out = FUNCTIONS[name](docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == sorted((d is None, d or 0) for d, _ in texts)
    assert FUNCTIONS[name](empty).count() == 0


@pytest.mark.parametrize("f", [quality.keep_good, line_dedup.remove_lines, simhash.keep_one, packing.pack_documents])
def test_empty_tables(f, empty):
    assert f(empty).count() == 0


def test_columns_stay(docs):
    for f in (quality.keep_good, line_dedup.remove_lines, simhash.keep_one, substring_dedup.substring_dedup):
        out = f(docs)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {EXTRA}


def plain(texts):
    return [(d, t) for d, t in dict.fromkeys(texts) if d is not None]


def test_exact(docs, texts):
    got = {tuple(r) for r in exact_dedup.exact_dedup(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])).collect()}
    assert got == brute.op4(plain(texts))
    nulls = [tuple(r)[1:4] for r in exact_dedup.exact_dedup(docs.where("doc_id IS NULL AND text IS NULL")).collect()]
    assert nulls == [(None, 1, True)]


def test_exact_with_heavy_hitters(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 7}" if i % 5 == 0 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (10, 100_000):
        assert {tuple(r) for r in exact_dedup.exact_dedup(df, top=4, counters=64, at_least=least).collect()} == brute.op4(rows)


def test_substring(spark, docs, texts):
    rows = plain(texts)
    out = substring_dedup.substring_dedup(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
    got = {r["doc_id"]: brute.WORD.findall(r["text"] or "") for r in out.collect()}
    want = {d: (n, gone, digest) for d, n, gone, digest in brute.op5(rows)}
    for d, t in rows:
        n, gone, digest = want[d]
        assert n - len(got[d]) == gone and brute.sha(" ".join(got[d])) == digest


def test_substring_random_passages(spark):
    r, rows = random.Random(5), []
    passages = [words(100 + i, r.randrange(45, 75)) for i in range(12)]
    for i in range(150):
        parts = [words(1000 + i * 7 + j, r.randrange(0, 60)) if r.random() < 0.5 else r.choice(passages) for j in range(r.randrange(1, 6))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(200 + i, rows[i % 5][1]) for i in range(20)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_log2=16)
    got = {(x["doc_id"], brute.sha(" ".join(brute.WORD.findall(x["text"])))) for x in out.collect()}
    assert got == {(d, digest) for d, _, _, digest in brute.op5(rows)}


def test_simhash(spark, texts):
    r, rows = random.Random(6), plain(texts)
    base = words(7, 900)
    for i in range(60):
        w = base.split()
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = "zz"
        rows.append((100 + i, " ".join(w)))
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(x) for x in out.collect()} == brute.op7(rows)


def test_near_copies_by_shingle_sets(spark):
    r, rows = random.Random(11), []
    for i in range(24):
        base = words(100 + i, 250).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 8):  # one to some ten words changed: from similarity 0.96 to below 0.8
            w = list(base)
            for at in r.sample(range(250), r.randrange(1, 11)):
                w[at] = "zz"
            rows.append((10 * i + k, " ".join(w)))
    rows += [(1000, "a b c"), (1001, "A  b c"), (1002, "a b d"), (None, rows[0][1]), (0, "quite another text under the first number")]
    sets = [(d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))) for d, t in rows for w in [t.lower().split()]]
    at = lambda d: (d is None, d or 0)
    gone = [i for i, (d, s) in enumerate(sets) if any(at(e) < at(d) and 5 * len(s & z) >= 4 * len(s | z) for e, z in sets)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((at(x["doc_id"]), x["text"]) for x in out.collect()))
    assert 60 < len(gone) < 160 and got == sorted((at(d), t) for i, (d, t) in enumerate(rows) if i not in gone)


def test_keep_one_judges_rows_by_id_and_text(spark):
    a, b = words(300, 40), words(301, 40)
    rows = [(3, a), (5, b), (5, a), (7, b), (None, a), (None, None), (9, "")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x["doc_id"] or 0, x["text"]) for x in out)) == [(3, a), (5, b), (9, "")]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    random.Random(1).shuffle(edges)
    got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def test_quality(spark, docs, texts):
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {tuple(r) for r in quality.quality_rules(docs.where("doc_id IS NOT NULL")).select(*base).collect()}
    assert got == brute.op8(plain(texts))


def test_quality_removes_boilerplate(spark):
    common = "subscribe to our letter and never miss any of the news we bring to you today"
    good = [(i, f"{words(i, 60)}\n{common}\n{words(i + 500, 40)}", "s", True) for i in range(60)]
    poor = [(100 + i, f"{common}\nown {i}", "s", False) for i in range(5)]
    few = [(200 + i, f"{words(9, 30)}\n{words(10, 30)}", "s", True) for i in range(20)]  # no more than the least
    rows = good + poor + few
    df = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df).collect()}
    assert got == {d: k for d, _, _, k in rows}


def test_quality_counts_documents(spark):
    block = [f"{words(20 + k, 12)} line {k}" for k in range(4)]
    poor = [(i, "\n".join([*block, f"own {words(i, 3)}"]), "s", False) for i in range(40)]
    good = [(100 + i, f"{words(600 + i, 60)}\n{words(900 + i, 40)}", "s", True) for i in range(60)]
    df = spark.createDataFrame([x[:3] for x in poor + good], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["kept"], r["n_removed_words"]) for r in quality.quality_rules(df).collect()}
    assert got == {d: (k, 0 if k else sum(len(x.split()) for x in block)) for d, _, _, k in poor + good}


def test_quality_finds_the_footer_of_equal_texts(spark):
    """40 of 100 documents have one text; of another host as many rows repeat one doc_id, which is one document."""
    text = f"{words(3, 30)}\nthe footer of the site"
    rows = [(i, text, "s") for i in range(40)] + [(100 + i, f"{words(600 + i, 60)}\n{words(900 + i, 40)}", "s") for i in range(60)]
    rows += [(7000, text, "t")] * 40 + [(8000 + i, words(i, 70), "t") for i in range(60)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in got if r["n_removed_words"]} == set(range(40)) == {r["doc_id"] for r in got if not r["kept"]}


def test_quality_stage_cuts_lines_above_the_limits(spark):
    import corpus_pipeline

    common = "Subscribe to our   LETTER and never miss 7 news"
    rows = [(i, f"{words(i, 60)}\n \n\t{common} \n{words(i + 500, 40)}\n", "s", 5) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, n_chars long")
    got = sorted(tuple(r) for r in corpus_pipeline.quality_stage(spark, df, "").collect())
    cut = [(i, f"{words(i, 60)}\n \n{words(i + 500, 40)}\n", "s") for i in range(60)]
    assert got == [(*x, len(x[1])) for x in [cut[0], *cut]]


def brute_lines(rows, similarity=(4, 5)):
    lines = [(d, i, frozenset(x.lower().encode().split())) for d, t in rows for i, x in enumerate((t or "").split("\n")) if brute.WORD.search(x)]
    lines.sort(key=lambda x: x[:2])
    out = {d: [] for d, _ in rows}
    for k, (d, i, s) in enumerate(lines):
        if any(similarity[1] * len(s & z) >= similarity[0] * len(s | z) for _, _, z in lines[:k]):
            out[d].append(i)
    return out


@pytest.mark.parametrize("shift,frequent", [(0, None), (1 << 60, None), (0, 4)])
def test_lines(spark, texts, shift, frequent, monkeypatch):
    """Positions as longs, as decimals (ids that span too much), and with the postings of frequent tokens parted by length."""
    if frequent is not None:
        monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
        monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    r, rows = random.Random(8), [(d - 3 if d != -3 else d - shift, t) for d, t in plain(texts)]
    pool = [words(i, r.randrange(1, 14), 60) for i in range(60)]
    for i in range(80):
        lines = []
        for _ in range(r.randrange(1, 7)):
            w = r.choice(pool).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = f"v{r.randrange(20)}"
            lines.append(" ".join(w))
        rows.append((100 + i, "\n".join(lines)))
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {x["doc_id"]: x for x in out.collect()}
    assert {d: x["removed_lines"] for d, x in out.items()} == brute_lines(rows)
    assert {d: x["n_lines"] for d, x in out.items()} == {d: sum(1 for x in (t or "").split("\n") if brute.WORD.search(x)) for d, t in rows}


def test_lines_of_rows_that_share_an_id(spark):
    line = "one line of some words that is held by all of these documents"
    rows = [(1, f"{line}\nfirst"), (1, f"{line}\nsecond"), (1, f"{line}\nsecond"), (None, f"third\n{line}"), (2, line)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and sorted((x["doc_id"] or 0, x["removed_lines"]) for x in out) == [(0, []), (1, [0]), (1, [0]), (1, [0]), (2, [0])]
    left = line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in left) == [(0, f"third\n{line}"), (1, "first"), (1, "second"), (1, "second"), (2, "")]
    own = [x for x in line_dedup.line_dedup(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect() if not x["removed_lines"]]
    assert len({x["text_key"] for x in own}) == 1  # of the texts under one id one comes first, in all its rows


def test_bpe(spark, docs, texts):
    rows = [(d, t) for d, t in plain(texts) if d != 12]
    got = {tuple(r) for r in bpe.bpe_round_trip(docs.where("doc_id <> 12").dropDuplicates(["doc_id", "text"])).collect()}
    assert got == brute.op2(rows)


def test_bpe_long_matches_and_safe_places():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    r = random.Random(3)
    for text in ("ab" * 3000, "x" * 4500, " " * 3000 + "a", "é漢" * 900, "a\x1cb \x1c c", "it's  'll\n\n x" * 50):
        assert bpe.encode(text, path, P.PATTERN) == enc.encode_ordinary(text)
    for _ in range(300):
        piece = bytes(r.choices(b"abcde thing", k=r.randrange(1, 60)))
        assert bpe.merge(piece, bpe.ranks(path)) == enc._core_bpe.encode_single_piece(piece)
    text = " ".join("".join(r.choices("ab c\n'sé1", k=9)) for _ in range(20_000))
    assert "".join(bpe.parts(text)) == text and len(list(bpe.parts(text))) > 2
    assert bpe.encode(text, path, P.PATTERN) == enc.encode_ordinary(text)
    assert bpe.decode([220, 128, 99], path, P.PATTERN) and tiktoken


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_tokenizer(name):
    import public_tokenizers as P

    m, r = memo_tokenizer.MemoTokenizer(P.path(name), capacity=50), random.Random(1)
    letters = " \n\t\r'stlédÉİΣσς1２ \x1c\x85aB,.!|’ÀÀﬁ漢字ßǅ"
    cases = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)] + ["", "  ", " a", "a ", "<|endoftext|> a", "it's 's 'S"]
    for text in cases:
        assert np.frombuffer(m.encode(text), "<u4").tolist() == m.full.encode(text, add_special_tokens=False).ids


def test_packing_limits():
    r = random.Random(2)
    limits = packing.Limits(64, 4, 40)
    examples = [packing.Example(i, np.arange(n := r.randrange(1, 64), dtype=np.uint32), np.array([r.random() < 0.5 and k < 40 for k in range(n)]), 0, n) for i in range(400)]
    examples = [x for x in examples if x.size()[2] <= 40]
    rows = list(packing.pack(examples, limits, False, 3))
    assert sorted(x[0] for x in rows) == [x.doc_id for x in examples]
    of = {x.doc_id: x for x in examples}
    for s in {x[5] for x in rows}:
        mine = [of[x[0]] for x in rows if x[5] == s]
        assert sum(len(x.ids) for x in mine) <= 64 and len(mine) <= 4 and sum(x.size()[2] for x in mine) <= 40
    with pytest.raises(ValueError):
        list(packing.pack([packing.Example(1, np.zeros(65, np.uint32), None, 0, 65)], limits, False, 0))


def test_packing_cuts_without_padding():
    r = random.Random(4)
    examples = [packing.Example(i, np.full(n := r.choice([0, 1, 5, 100, 1024, 5000]), i, np.uint32), None, 0, n) for i in range(200)]
    rows = list(packing.pack(examples, packing.Limits(), True, 0))
    assert sum(x[2] for x in rows) == sum(len(x.ids) for x in examples)
    assert all(x[8] == x[7] for x in rows)


def test_packing_documents(docs, texts):
    from .test_contracts import check_packing

    rows = [(d, t) for d, t in plain(texts) if d != 12]
    check_packing(packing.pack_documents(docs.where("doc_id <> 12").dropDuplicates(["doc_id", "text"])).toPandas(), rows)


def test_packing_conversations(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", words(c * 10 + t, 30)) for c in range(40) for t in range(4)] + [(99, 0, "user", None)]
    out = packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).toPandas()
    assert set(out["doc_id"]) == {*range(40), 99} and (out.groupby("sequence_id")["length"].sum() <= 2048).all() and (out.groupby("sequence_id").size() <= 16).all()
    assert (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].max()).all()
    alone = [(None, t, "user", words(t, 20)) for t in range(6)] + [(None, 0, "user", None)]
    out = packing.pack_conversations(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")).toPandas()
    assert len(out) == 7 and out["doc_id"].isna().all()
    assert packing.pack_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_blocks():
    r = np.random.default_rng(0)
    for ids in (np.zeros(1, np.uint32), np.arange(5000, dtype=np.uint32)[:4096], r.integers(0, 2**32, 4096, dtype=np.uint32), np.array([7] * 4000 + [2**32 - 1] * 96, np.uint32), np.array([5] * 100, np.uint32)):
        raw = token_file.pack_block(ids)
        assert (token_file.unpack_block(raw) == ids).all()
    assert len(token_file.pack_block(np.array([7] * 4000 + [2**32 - 1] * 96, np.uint32))) < 1000


def test_token_files(spark, docs, texts):
    rows = [(d, t) for d, t in plain(texts) if d != 12]
    got = {tuple(r) for r in token_file.token_files(docs.where("doc_id <> 12").dropDuplicates(["doc_id", "text"])).collect()}
    assert got == brute.op3(rows)


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage(compressed):
    raw = [warc.record(i, f"http://a/{i}", b"x" * 50 * i + b"\x1f\x8b\x08 WARC/1.0") for i in range(6)]
    parts = [warc.member(x) if compressed else x for x in raw]
    whole = b"".join(parts)
    ids = lambda data: [warc.page_of(x.headers["warc-record-id"]) for x in warc.Salvage(Bytes(data)) if isinstance(x, warc.Record)]
    gaps = lambda data: [(x.at, x.size) for x in warc.Salvage(Bytes(data)) if isinstance(x, warc.Gap)]
    assert ids(whole) == list(range(6)) and gaps(whole) == []
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    bad = bytearray(whole)
    bad[starts[2] + len(parts[2]) // 2] ^= 0xFF
    assert ids(bytes(bad)) == [0, 1, 3, 4, 5] and gaps(bytes(bad)) == [(starts[2], len(parts[2]))]
    cut = whole[: starts[1]] + whole[starts[1] + 20 : starts[5] + 10]
    assert ids(cut) == [0, 2, 3, 4] and gaps(cut)[0] == (starts[1], len(parts[1]) - 20)
    assert ids(b"noise" + whole) == list(range(6)) and gaps(b"noise" + whole) == [(0, 5)]
    assert ids(b"") == [] and gaps(b"junk") == [(0, 4)]
    if compressed:
        assert b"".join(gzip.decompress(p) for p in parts) == b"".join(raw)


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_with_any_byte_changed(compressed):
    """Whatever byte is damaged, by whichever of two masks: what is returned is as it was written, and at most that one record goes."""
    raw = [warc.record(i, f"http://a/{i}", b"y" * 9 * i, refers_to=7 if i == 1 else None) for i in range(3)]
    parts = [warc.member(x) if compressed else x for x in raw]
    whole, starts = b"".join(parts), np.cumsum([0, *map(len, parts)]).tolist()
    read = lambda data: [(x.headers["warc-record-id"], x.headers["warc-type"], x.headers["warc-target-uri"], x.headers.get("warc-refers-to"), x.headers["warc-payload-digest"], x.payload()) for x in warc.Salvage(Bytes(data)) if isinstance(x, warc.Record)]
    good = read(whole)
    assert len(good) == 3
    for at in range(len(whole)):
        for mask in (0xFF, 0x01, 0x20):
            bad = bytearray(whole)
            bad[at] ^= mask
            hit = next(i for i in range(3) if starts[i] <= at < starts[i + 1])
            rest = [x for i, x in enumerate(good) if i != hit]
            assert read(bytes(bad)) in (good, rest), (at, mask)


def test_warc(spark):
    rows = [(1, "http://a", "same", "x"), (2, None, "same", "x"), (3, "http://c\nd", None, "x"), (4, "u", "", "x"), (None, "u", "same", "x"), (5, "u", "é" * 70_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    got = {tuple(r) for r in warc.warc_round_trip(df).collect()}
    want = brute.op6([(p, h) for p, _, h, _ in rows if p is not None])
    assert {x for x in got if x[0] is not None} == want and [x[3] for x in got if x[0] is None] == ["response"]
    assert warc.warc_round_trip(df.where("page_id > 99")).count() == 0
    assert warc.read_warc(spark.createDataFrame([], "file string")).count() == 0


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def verdict(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x#y", "https://example.com/de/", "http://example.com/de", "http://x.org/fr/a", "http://notorg/fr/", "http://org/fr/", "ftp://b.net", "http://b.net/?q", "http://b.net#f", "a://b://c/d", "http://ÉÀ.net/é", "http://example.net/en", "http://sub.example.com/de/x?y=/en/"]


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h"), (None, "http://a.net/", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.url_verdicts(df, none).collect()}
    want = set()
    for i, u, _ in rows:
        h, p = host_path(u)
        rule, v = verdict(h, p)
        want.add((i, h, p, rule, v or "allow"))
    assert got == want
    assert url_rules.url_verdicts(df.where("page_id > 999"), none).count() == 0


def brute_tokens(url):
    host, path = host_path(url)
    labels = host.split(".")
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else ""
    out = {"scheme:" + (re.match("[A-Za-z]*", url)[0] if re.match("[A-Za-z]*://", url) else ""), "extension:" + (re.search(r"\.([A-Za-z]{1,5})$", path) or ["", ""])[1]}
    out |= {"host:" + ".".join(labels[i:]) for i in range(len(labels))}
    out |= {"path:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}
    return out | {"query:" + x.split("=")[0] for x in query.split("&") if x}


def brute_rules(labelled, support=0.004, confidence=0.8, least=10, margin=0.1, longest=3, basket=None):
    """The mined rules by counting every set of at most longest of every URL's tokens, of tokens in the same URLs the first."""
    rows = [(brute_tokens(u), b) for u, b in labelled]
    total, bad = len(rows), sum(b for _, b in rows)
    floor = max(least, math.ceil(support * total - 1e-9))
    if bad < floor:
        return {}
    n_bad, where = Counter(t for ts, b in rows if b for t in ts), {}
    for u, _ in labelled:
        for t in brute_tokens(u):
            where.setdefault(t, set()).add(u)
    first = {}
    for t in sorted(where):
        if n_bad[t] >= floor:
            first.setdefault(frozenset(where[t]), t)
    known, sets = set(first.values()), Counter()
    for ts, b in rows:
        if b:
            sets.update(frozenset(c) for k in range(1, longest + 1) for c in combinations(sorted(ts & known), k))
    found = {}
    for s, freq in sets.items():
        if freq >= floor:
            a, k = sum(s <= ts for ts, _ in rows), sum(s <= ts for ts, b in rows if b)
            p, z = k / a, 2.58
            low = (p + z * z / (2 * a) - z * math.sqrt((p * (1 - p) + z * z / (4 * a)) / a)) / (1 + z * z / a)
            if k >= confidence * a and low >= bad / total + margin:
                found[s] = p
    return {s: p for s, p in found.items() if not any(z < s and found[z] >= p for z in found)}


def labelled_sample(n, seed=3):
    r, out = random.Random(seed), []
    for i in range(n):
        host = r.choice(["a.shop.example.com", "shop.example.com", "b.news.example.org", "news.example.org", "c.example.net"])
        path = "/".join(r.choices(["casino", "news", "win", f"p{i}", "de"], k=r.randrange(1, 5)))
        url = f"{r.choice(['http', 'https'])}://{host}/{path}{r.choice(['', '.html', '/'])}{r.choice(['', '?ref=1', '?a=2&utm=x'])}"
        bad = ("casino" in path and "shop" in host and r.random() < 0.95) or ("win" in path and "utm" in url and r.random() < 0.8) or r.random() < 0.05
        out.append((url, bad))
    return out + out[:20]


@pytest.mark.parametrize("longest,basket", [(3, 12), (2, 4), (3, 3)])
def test_mined_rules_and_verdicts(spark, longest, basket):
    labelled = labelled_sample(500)
    parameters = dict(support=0.02, confidence=0.6, least=8, margin=0.1, longest=longest, basket=basket)
    want = brute_rules(labelled, **parameters)
    frame = spark.createDataFrame(labelled, "url string, bad boolean")
    got = {frozenset(r["tokens"]): r["confidence"] for r in url_rules.mined_rules(frame, **parameters).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-12 for s in got) and len(got) > 2
    rows = [(i, u) for i, u in enumerate([*URLS, *(u for u, _ in labelled_sample(200, 4))])]
    out = url_rules.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), frame, **parameters)
    fires = lambda u: any(s <= brute_tokens(u or "") for s in want)
    expect = {(i, rule, v or ("block" if fires(u) else "allow"), fires(u)) for i, u in rows for rule, v in [verdict(*host_path(u))]}
    assert {(r["page_id"], r["rule"], r["verdict"], r["mined"]) for r in out.collect()} == expect and any(x[3] for x in expect)


def test_mined_rules_of_noise_and_of_very_long_urls(spark):
    r = random.Random(9)
    noise = [(f"http://h{r.randrange(4)}.example.com/{r.choice('abc')}/{i}", r.random() < 0.25) for i in range(600)]
    assert url_rules.mined_rules(spark.createDataFrame(noise, "url string, bad boolean")).count() == 0
    long = "http://h.example.com/" + "/".join(f"seg{'x' * i}" for i in range(200))
    frame = spark.createDataFrame([(long, True)] * 30 + [(f"http://h.example.com/{i}", False) for i in range(60)], "url string, bad boolean")
    began = time.time()
    rules = url_rules.mined_rules(frame).collect()
    assert [x["tokens"] for x in rules] == [["path:seg"]] and time.time() - began < 60
    n, bad, hits, right = url_rules.held_out(spark.createDataFrame(labelled_sample(800), "url string, bad boolean"), least=8)
    assert n > 100 and hits > 0.3 * bad and right > 0.7 * hits


def test_a_rule_of_tokens_that_no_ten_best_hold(spark):
    """Many tokens of a URL point to bad labels more than the two that make the rule together; each URL has another sample of them."""
    r = random.Random(5)
    tokens = [f"t{chr(97 + k)}" for k in range(26)]
    labelled = [("http://h.example/" + "/".join(sorted(r.sample(tokens, 16)) + ["ya", "yb"]), True) for _ in range(30)] + [(f"http://h.example/{x}/{i}", False) for i in range(40) for x in ("ya", "yb")]
    got = {frozenset(x["tokens"]): x["confidence"] for x in url_rules.mined_rules(spark.createDataFrame(labelled, "url string, bad boolean"), basket=9).collect()}
    assert got == brute_rules(labelled) and frozenset({"path:ya", "path:yb"}) in got


def test_split_baskets(spark):
    for n, longest, basket in ((5, 3, 3), (13, 3, 6), (20, 2, 6), (7, 1, 2), (12, 3, 12)):
        items = [f"i{k:02}" for k in range(n)]
        out = [set(r[0]) for r in spark.createDataFrame([(items,)], "items array<string>").select(url_rules.F.explode(url_rules.split_baskets(url_rules.F.col("items"), longest, basket))).collect()]
        assert all(len(x) <= basket for x in out) and all(any(set(c) <= x for x in out) for c in combinations(items, longest))


def test_clashing_columns_of_pages(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "t", 2, "k", True, "h")], "page_id long, url string, token string, rule_id int, url_key string, hit boolean, host string")
    assert [tuple(r) for r in url_rules.url_verdicts(df, spark.createDataFrame(labelled_sample(100), "url string, bad boolean")).select("page_id", "host", "path", "rule", "verdict").collect()] == [(1, "a.net", "/x", "net/", "block")]


def test_mined_urls(spark):
    labelled = [(f"http://h{i % 5}.example/{'casino' if i % 4 == 0 else 'news'}/{i}?{'ref' if i % 2 else 'page'}=1", i % 4 == 0 and i % 5 < 3) for i in range(400)]
    rules = url_rules.mined_rules(spark.createDataFrame(labelled, "url string, bad boolean"), 0.02, 0.9).collect()
    sets = [set(r["tokens"]) for r in rules]
    assert sets and all("path:casino" in s for s in sets) and not any(a < b for a in sets for b in sets)
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id long, url string")
    out = url_rules.url_verdicts(df, spark.createDataFrame(labelled, "url string, bad boolean"), support=0.02, confidence=0.9)
    assert {r["page_id"] for r in out.where("mined").collect()} == {i for i, (_, bad) in enumerate(labelled) if bad}



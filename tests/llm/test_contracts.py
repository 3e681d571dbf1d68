"""The queries over the small tables, whole, against loops."""

import glob
import os
import re

import numpy as np
import pandas as pd
import pytest

from lattica.llm import common, queries

from . import brute

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_op2(spark, docs):
    assert rows(queries.op2_bpe(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.op2(docs)


def test_op3(spark, docs):
    assert rows(queries.op3_token_file(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == brute.op3(docs)


def test_op4(spark, docs):
    assert rows(queries.op4_exact_dedup(spark, SF), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.op4(docs)


def test_op5(spark, docs):
    assert rows(queries.op5_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.op5(docs)


def test_op6(spark):
    pages = [tuple(r) for r in common.table(spark, SF, "pages").select("page_id", "html").collect()]
    assert rows(queries.op6_warc(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.op6(pages)


def test_op7(spark, docs):
    assert rows(queries.op7_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == brute.op7(docs)


def test_op8(spark, docs):
    out = queries.op8_quality(spark, SF)
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(out, *base) == brute.op8(docs)
    assert out.where("kept and base_failed").count() == 0


def check_packing(pieces, docs, name="byte_bpe_50k.json", end=0, limit=1024):
    ids = {d: [*brute.ids_of(name, t), end] for d, t in docs}
    for d, part in pieces.groupby("doc_id"):
        part, at = part.sort_values("start"), 0
        for x in part.itertuples():
            assert x.start == at and x.doc_tokens == len(ids[d])
            assert x.ids_crc32 == brute.crc(ids[d][at : at + x.length])
            at += x.length
        assert at == len(ids[d])
    assert set(pieces["doc_id"]) == set(ids)
    padding = 0
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1].tolist()]
        n = part["length"].sum()
        assert n <= limit
        padding += 0 if n & (n - 1) == 0 else limit - n
    assert padding <= 0.01 * pieces["length"].sum()


def test_op1(spark, docs):
    check_packing(queries.op1_packing(spark, SF).toPandas(), docs)


def test_op9(spark):
    """The query against a loop over its tables."""
    from .test_edges import brute_rules, brute_tokens, host_path, verdict

    pages = [tuple(r) for r in common.table(spark, SF, "pages").select("page_id", "url").collect()]
    bad = {}
    for r in common.table(spark, SF, "labels").collect():
        bad[r["doc_id"]] = bad.get(r["doc_id"], False) or r["quality"] == 0 or r["toxic"] == 1
    named = [(u, re.search(r"/([0-9]{1,18})", host_path(u)[1])) for _, u in pages]
    labelled = [(u, bad[int(m[1])]) for u, m in named if m and int(m[1]) in bad]
    mined, want = brute_rules(labelled), set()
    for i, u in pages:
        rule, said = verdict(*host_path(u))
        want.add((i, *host_path(u), rule, said or ("block" if any(s <= brute_tokens(u or "") for s in mined) else "allow")))
    assert labelled and rows(queries.op9_url_rules(spark, SF), "page_id", "host", "path", "rule", "verdict") == want


def test_op10(spark, docs):
    from .test_edges import brute_lines

    gone = brute_lines(docs)
    got = {r["doc_id"]: r for r in queries.op10_line_dedup(spark, SF).collect()}
    assert set(got) == {d for d, _ in docs}
    assert {d: sorted(r["removed_lines"] or []) for d, r in got.items()} == {d: sorted(gone[d]) for d, _ in docs}

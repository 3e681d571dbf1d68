"""Every stage of the pipeline over whole small tables, against loops."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import common, quality

from . import brute
from .test_contracts import SF, check_packing
from .test_edges import brute_lines


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        after = common.materialise(f(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for name, (before, after) in steps.items():
        if name != "packing":
            assert after.schema.simpleString() == before.schema.simpleString()


def test_quality(steps):
    before, after = steps["quality"]
    failed = {x[0] for x in brute.op8(list(texts(before).items())) if x[-1]}
    kept = {r["doc_id"] for r in quality.quality_rules(before).where("kept").collect()}
    assert texts(after) == {d: t for d, t in texts(before).items() if d in kept} and not failed & kept
    assert len(kept) >= 0.95 * (len(texts(before)) - len(failed))


def test_lines(steps):
    before, after = (texts(x) for x in steps["lines"])
    gone = brute_lines(list(before.items()))
    assert after == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before.items()}
    assert steps["lines"][1].where(F.col("n_chars") != F.length("text")).count() == 0


def test_near(steps):
    """Kept is what no smaller doc_id reaches by fingerprints two bits apart or has a shingle set in common with, of similarity 0.8."""
    before, after = (texts(x) for x in steps["near"])
    shingles = {}
    for d, t in before.items():
        w = (t or "").encode().lower().split()
        shingles[d] = [b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    fps, sets, root = {}, {d: frozenset(s) for d, s in shingles.items()}, {d: d for d in before}
    for d, s in shingles.items():
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)
        fps[d] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) if s else 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, late = sorted(before), set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                late.add(b)
    assert set(after) == {d for d in ids if find(d) == d and d not in late}


def test_substrings(steps):
    before, after = (texts(x) for x in steps["substrings"])
    want = {d: digest for d, _, _, digest in brute.op5(list(before.items()))}
    assert {d: brute.sha(" ".join(brute.WORD.findall(t or ""))) for d, t in after.items()} == want


def test_run_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """The whole pipeline over a small table of edge cases, and over an empty one."""
    long = " ".join(f"w{i % 97}x{i}" for i in range(400))
    cases = [(1, long), (2, long), (None, long), (3, None), (4, ""), (None, None), (5, "one two three four five six seven eight nine ten eleven\nsome other words of its own, which are enough to stay here"), (6, long + " more"), (6, long + " more")]
    rows = [(d, t, "en", None if d == 5 else "s", 1, "x", 2, "y", "z", 3, "k") for d, t in cases]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, text_key int, kept string, removed_lines string, id int, first string"
    for name, data in (("cases", rows), ("empty", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # a null doc_id is first among lines, so that 1, 2 and 6 lose theirs, and one wordless document stays
        assert {r["doc_id"] for r in out} == ({None, 1, 5} if data else set())


def test_packing(steps):
    before, after = steps["packing"]
    check_packing(after.toPandas(), list(texts(before).items()))


def test_tables_behind_are_deleted(spark, tmp_path, monkeypatch):
    """Stages written one by one leave the last one's intermediate tables only; one that is chained without being written keeps what it reads."""
    monkeypatch.setattr(common, "scratch", lambda spark, what: f"{tmp_path}/scratch/{what}-{len(list(tmp_path.rglob('*')))}")
    docs = spark.createDataFrame([(i, f"{' '.join(f'w{i * 31 % 17}x{k}' for k in range(60))}\nline of its own {i}", "en", "s", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    names = lambda: {p.name.rsplit("-", 1)[0] for p in (tmp_path / "scratch").iterdir()}
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        seen.append(names())
    assert "base-counts" in seen[0] and "base-counts" not in seen[1] and "lines" in seen[1] and "lines" not in seen[2] and docs.count() == 12
    lazily = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert corpus_pipeline.STAGES[1][1](spark, lazily, "").count() == 12

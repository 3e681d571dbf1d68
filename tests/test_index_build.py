"""The blocks of a segment are made and written where its texts are: tokens aren't shuffled."""

from pyspark.sql import functions as F

from lattica.functions.tokenize import code_tokens, whole_tokens
from lattica.operators import postings


def test_blocks_lie_with_their_segment(spark, tmp_path):
    rows = [(f"r{i % 2}", f"n{i:04}", "File", "name", f"p/{i}", " ".join(f"w{(i * k) % 37}" for k in range(1, 12))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "repo string, node_id string, kind string, name string, path string, content string")
    index = postings.build(docs, f"file://{tmp_path}")
    task = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1)
    told = index.blocks.withColumn("task", task).groupBy("segment").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("n"), F.count_distinct("field", "token", "repo").alias("blocks")).collect()
    assert len(told) > 1 and all(r["tasks"] == 1 and r["n"] == r["blocks"] for r in told)
    assert index.blocks.where("field = 'content'").agg(F.sum(F.aggregate("docs.tf", F.lit(0), lambda a, x: a + x))).first()[0] == 3000 * 11


def test_an_index_is_written_in_few_files_and_alike_blocks_once(spark, tmp_path):
    plain, camel = "the cat of the house and the dog", "the catOf the house HTTPServer  theEnd"
    rows = [("r", f"n{i:04}", "File", "name", f"p/{i}", {0: camel, 1: "", 2: None, 3: "!"}.get(i % 50, plain)) for i in range(1500)]
    rows.append(("s", "n", "Symbol", "aName", None, None))
    docs = spark.createDataFrame(rows, "repo string, node_id string, kind string, name string, path string, content string").repartition(4)
    index = postings.build(docs, f"file://{tmp_path}")
    # a directory has one file of each file of documents, and there are few directories however many documents
    assert len(list(tmp_path.glob("blocks/*/*.parquet"))) <= 8 * len(list(tmp_path.glob("docs/*.parquet"))) <= 8 * 4
    stored = spark.read.parquet(f"{tmp_path}/blocks")
    assert stored.where("field = 'path_whole'").count() == 0 < stored.where("field = 'content_whole'").count()  # paths have no camels, some contents have
    got, want = {}, {}
    for r in index.blocks.join(index.docs.select("doc", "node_id"), F.array_contains("docs.doc", F.col("doc"))).collect():
        at = [x["doc"] for x in r["docs"]].index(r["doc"])
        got[r["field"], r["token"], r["node_id"], r["repo"]] = r["positions"][at]
        assert r["docs"][at]["tf"] == len(r["positions"][at]) and r["n"] == len(r["docs"])
    split = {"content": code_tokens(F.coalesce("content", F.lit(""))), "content_whole": whole_tokens(F.coalesce("content", F.lit(""))), "path_whole": whole_tokens(F.coalesce("path", F.lit("")))}
    split |= {"name": code_tokens(F.col("name")), "raw_name": F.when(F.col("kind") == "Symbol", F.array("name")).otherwise(F.array())}
    for f, tokens in split.items():
        for r in docs.select("node_id", "repo", F.posexplode(tokens).alias("pos", "token")).collect():
            want.setdefault((f, r["token"], r["node_id"], r["repo"]), []).append(r["pos"])
    assert {k: v for k, v in got.items() if k[0] in split} == want
    means = {r["repo"]: r["avg_content"] for r in index.stats.collect()}
    n = docs.where("repo = 'r'").select(F.avg(F.size(split["content"]))).first()[0]
    assert means == {"r": n, "s": 0.0}

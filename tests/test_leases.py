"""Leases: the step, the table, and the stream that agrees with it, across a restart and without input at a lease's end."""

import pytest
from pyspark.sql import functions as F

from lattica.streaming import leases

SCHEMA = "job long, ts long, id long, worker long, settles boolean"
S = 1_000_000


def test_steps(spark):
    rows = [(1, 0, 1, 7, False), (1, 50 * S, 2, 7, False), (1, 100 * S, 3, 8, False), (1, 151 * S, 4, 8, False), (1, 160 * S, 5, 8, True), (1, 161 * S, 6, 7, True), (2, 5, 7, 9, None), (None, 5, 8, 9, False), (3, None, 9, 9, False), (3, 5, 10, None, False), (2, 5, 7, 9, None)]
    got = {tuple(r) for r in leases.lease_log(spark.createDataFrame(rows, SCHEMA), 100).collect()}
    assert got == {
        (1, 0, 1, "claimed", 7, 1), (1, 50 * S, 2, "renewed", 7, 1), (1, 100 * S, 3, "refused", 8, 1), (1, 150 * S, None, "expired", 7, 1), (1, 151 * S, 4, "claimed", 8, 2), (1, 160 * S, 5, "settled", 8, 2), (1, 161 * S, 6, "claimed", 7, 3), (1, 261 * S, None, "expired", 7, 3),
        (2, 5, 7, "claimed", 9, 1), (2, 5, 7, "renewed", 9, 1), (2, 100 * S + 5, None, "expired", 9, 1),
    }
    assert leases.lease_log(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_agrees_with_table(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(j, (1 + i * 37 + j * 11) * S, i * 10 + j, (i * i + j) % 3, i % 7 == 5) for j in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in leases.lease_log(df, 60).collect()}
    whole = (tmp_path / "in").as_uri()
    for k in range(3):  # a run each, which goes on from the state of the one before
        mine = df.where(F.floor(F.col("ts") / (400 * S)) == k)
        if k == 2:  # much later something else is asked for; the last leases end by their timers
            mine = mine.unionByName(spark.createDataFrame([(99, 10_000 * S, 999, 1, False)], SCHEMA))
        mine.coalesce(1).write.mode("append").parquet(whole)
        stream = leases.stream_leases(spark.readStream.schema(SCHEMA).parquet(whole), 60)
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(300)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("job <> 99").collect()]
    assert len(got) == len(set(got)) and set(got) == want and sum(r[3] == "expired" for r in want) > 3

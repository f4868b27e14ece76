"""Streams against the same computation on the whole table."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.streaming import sessions as S

SCHEMA = "user string, ts timestamp, seq long, x double"


def source(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(u, i, int(rng.integers(0, 50)) * 60 * i, float(rng.normal() + i)) for u in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "user string, seq long, s long, x double").select("user", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "seq", "x")
    for k in range(3):
        df.where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def collect(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_running_trend(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    out = collect(spark, S.running_trend(stream, "user", "x"), "trend", "update", tmp_path)
    assert out.count() >= 2 and {r.n for r in out.groupBy("user").agg(F.max("n").alias("n")).collect()} == {30}


def test_windows_and_sessions(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    out = collect(spark, S.tumbling(stream, "user", "ts", "x", late="1000 days"), "tumbling", "complete", tmp_path)
    assert out.agg(F.sum("n")).first()[0] == df.count()
    batch = S.sessions(df, "user", "ts")
    assert batch.agg(F.sum("n_events")).first()[0] == df.count()

"""A stream over files gives what the batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.streaming import streams as T


def run(spark, df, tmp_path, make):
    """df in three files by order of its first column, read one file a batch."""
    rows = df.orderBy(df.columns[0]).collect()
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("name", ["limit", "health", "feed", "scale"])
def test_stream_is_batch(spark, tmp_path, name):
    base = spark.range(90).withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1000)))
    df, batch, stream = {
        "limit": (base.select((F.col("id") * 3.0).alias("at"), (F.col("id") % 2).cast("string").alias("client"), F.col("id").alias("event_id")), lambda d: T.rate_limit(d, 4), lambda d: T.stream_rate_limit(d, 4)),
        "health": (base.select((F.col("id") * 1.0).alias("at"), (F.col("id") % 2).cast("int").alias("node"), F.col("id").alias("event_id"), F.col("u").cast("double").alias("duration_ms"), F.when(F.col("u") < 600, 500).otherwise(200).alias("status_code")), T.node_health, T.stream_node_health),
        "feed": (base.select(F.col("id").cast("int").alias("seq"), (F.col("id") % 4).cast("string").alias("job_id"), F.when(F.col("u") > 950, "completed").otherwise("downloading").alias("status"), (F.col("u") % 3).cast("double").alias("percent")), T.change_feed_fold, T.stream_change_feed),
        "scale": (base.select((F.col("id") * 8).alias("tick"), (F.col("id") % 2).cast("string").alias("service"), (F.col("u") / 10).alias("avg_cpu"), (F.col("u") / 10).alias("max_cpu"), (F.col("u") / 10).alias("effective")), T.scale_decisions, T.stream_scale_decisions),
    }[name]
    got = run(spark, df, tmp_path, stream)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch(df).collect()))


def test_circuit_stays_open_after_a_success(spark):
    """Three failures at 0, 1 and 2 s open the circuit until 17 s; successes leave that as it is, a fourth failure streak moves it."""
    codes = [500, 500, 500, 200, 200, 500, 500, 500, 500]
    df = spark.createDataFrame([(1, k, float(k), 10.0, c) for k, c in enumerate(codes)], "node int, event_id long, at double, duration_ms double, status_code int")
    got = [r["open_until"] for r in T.node_health(df).orderBy("event_id").collect()]
    assert got == [0.0, 0.0, 17.0, 17.0, 17.0, 17.0, 17.0, 22.0, 23.0]
    state, walked = T.HEALTH_START, []
    for r in df.orderBy("event_id").collect():
        state, out = T.health_step()(state, r)
        walked.append(out[3])
    assert walked == got


def test_scaling_rules(spark):
    """One container of three at 90 % asks for more although their average is 36.7 %; 35 % beside 5 % forbids less; 12, 8 and 4 % allow it."""
    rows = [(t, c) for t, group in enumerate([(90.0, 10.0, 10.0)] * 2 + [(35.0, 5.0, 5.0)] * 5 + [(12.0, 8.0, 4.0)] * 4) for c in group]
    samples = spark.createDataFrame([("app", t * 60, c) for t, c in rows], "service string, at long, cpu double").withColumn("ts", F.timestamp_seconds("at"))
    metrics = T.interval_metrics(samples, 60)
    assert metrics.orderBy("tick").first()["avg_cpu"] == pytest.approx(36.6667, abs=1e-3) and metrics.orderBy("tick").first()["effective"] == 85.5
    got = {r["tick"] // 60: (r["action"], r["replicas"]) for r in T.scale_decisions(metrics).collect()}
    assert got[0] == (0, 1) and got[1] == (1, 2) and all(got[t] == (0, 2) for t in range(2, 10)) and got[10] == (-1, 1)


def test_each_service_has_its_thresholds(spark):
    """The same samples: `a` may grow to 2 at 50 %, `b` needs 95 %, `c` isn't configured and isn't scaled; intervals differ."""
    config = readers.load_scale_config(spark, "a:1:2:50:10:60, b:1:5:95:10:120")
    samples = spark.range(60).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("service"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.lit(70.0).alias("cpu"))
    got = T.scale_decisions(T.interval_metrics(samples, config=config), config)
    by = {s: [(r["tick"], r["replicas"]) for r in got.orderBy("tick").collect() if r["service"] == s] for s in "abc"}
    assert by["c"] == [] and max(n for _, n in by["a"]) == 2 and max(n for _, n in by["b"]) == 1 and len(by["a"]) == 30 and len(by["b"]) == 15


def test_samples_to_decisions_is_batch(spark, tmp_path):
    """Raw samples in three files, thresholds of three services, windows and state in one query: the rows of the batch."""
    config = readers.load_scale_config(spark, "s0:1:4:80:30:60, s1:1:2:60:40:120, s2:2:6:90:20:60")
    base = spark.range(3000).withColumn("u", F.pmod(F.xxhash64("id"), F.lit(100)))
    cpu = F.when(F.col("id") % 1000 < 500, F.col("u") / 4 + 75).otherwise(F.col("u") / 10)
    samples = base.select((F.col("id") * 7).alias("at"), F.concat(F.lit("s"), F.col("id") % 4).alias("service"), cpu.alias("cpu")).withColumn("ts", F.timestamp_seconds("at"))
    closing = spark.createDataFrame([(10**7, "closing", 0.0)], "at long, service string, cpu double").withColumn("ts", F.timestamp_seconds("at"))
    got = run(spark, samples.unionByName(closing), tmp_path, lambda d: T.stream_scaling(d, config, late="2 minutes"))
    want = T.scale_decisions(T.interval_metrics(samples, config=config), config)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.where("action <> 0").count() > 5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rate_limit_by_doubling_is_a_walk(spark, seed):
    """Random calls, one client with half of them, equal times, long pauses: the verdicts of the walk."""
    rnd = random.Random(seed)
    calls = [(rnd.choice(["hot", "hot", "a", "b"]), k, float(rnd.choice([rnd.randrange(3000), rnd.randrange(40) * 75]))) for k in range(900)] + [("once", 5000, 7.0), (None, 5001, 3.0)]
    df = spark.createDataFrame(calls, "client string, event_id long, at double")
    want = T.fold(df, "client", ["at", "event_id"], T.limit_step(3), (-1, 0.0), T.LIMIT_SCHEMA)
    got = T.rate_limit(df, 3)
    assert sorted(map(str, got.where("client IS NOT NULL").collect())) == sorted(map(str, want.where("client IS NOT NULL").collect()))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_hot_key_on_a_stream_is_cut_into_slices(spark, tmp_path):
    """A key with far more rows in a batch than a frame holds comes by slices, in order, whatever the order in which frames bring it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200)
    try:
        df = spark.range(6000).select(F.pmod(F.col("id") * 3541, F.lit(6000)).cast("double").alias("at"), F.when(F.col("id") % 50 > 0, "hot").otherwise("cold").alias("client"), F.col("id").alias("event_id"))
        df.repartition(8).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        T.stream_rate_limit(stream, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(200)
        got = spark.read.parquet(str(tmp_path / "out"))
        assert sorted(map(str, got.collect())) == sorted(map(str, T.rate_limit(df, 4).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fold_holds_a_batch_only(spark):
    """One key of many rows comes to the step in batches, in order, with the state carried over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        sizes = spark.range(1000).select(F.when(F.col("id") < 990, "hot").otherwise("cold").alias("k"), F.pmod(F.col("id") * 7, F.lit(1000)).alias("at"))
        got = T.fold(sizes, "k", ["at"], lambda state, row: ((state[0] + 1,), (row.at, state[0] + 1)), (0,), "k string, at long, n int")
        assert "MapInPandas" in got._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        for k in ("hot", "cold"):
            rows = sorted((r["at"], r["n"]) for r in got.collect() if r["k"] == k)
            assert [n for _, n in rows] == list(range(1, (990 if k == "hot" else 10) + 1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

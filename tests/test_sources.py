"""Readers and writers on small files, and golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.sources import readers as R


def test_job_events(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"job_id":"a","status":"downloading","percent":3.5}\n\n{bad\n{"job_id":"a","status":"completed","percent":100}\n')
    assert [r["percent"] for r in R.read_job_events(spark, str(tmp_path)).orderBy("percent").collect()] == [3.5, 100.0]


def test_spans_round_trip(spark, tmp_path):
    rows = [("t1", "s1", None, "root", "web", 10, 20, 1, {"k": "v"}), ("t1", "s2", "s1", "leaf", "web", 11, 12, 2, {}), ("t2", "s3", None, "other", "db", 5, 6, 1, {"n": "3"})]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, service string, start_nanos long, end_nanos long, status int, attrs map<string,string>")
    R.write_spans(df, str(tmp_path / "out"))
    back = R.read_spans(spark, str(tmp_path / "out")).select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nfirst\nsecond\n\n2\n00:00:03,000 --> 00:00:04,000\nlost\n00:00:05,000 --> 00:00:06,000\nkept")
    got = R.read_subtitles(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1.0, 2.5, "first\nsecond"), (5.0, 6.0, "kept")]


@pytest.mark.parametrize(("fmt", "style", "want"), [
    ("txt", "gateway", "a b"), ("txt", "worker", "a\nb"), ("srt", "worker", "1\n00:00:00,000 --> 00:00:01,500\na\n\n2\n00:00:02,000 --> 00:00:03,000\nb"),
    ("vtt", "worker", "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\na\n\n00:00:02.000 --> 00:00:03.000\nb"),
])
def test_subtitle_text(spark, fmt, style, want):
    df = spark.createDataFrame([("m", 2, 2.0, 3.0, "b"), ("m", 1, 0.0, 1.5, "a")], "media_id string, id int, start double, end double, text string")
    assert R.subtitle_text(df, fmt, style).first()["value"] == want


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"transcription": [{"offsets": {"from": 0, "to": 1234}, "text": " hi ", "avg_logprob": 0, "logprob": -0.5}, {"offsets": {"from": 1234, "to": 2000}, "text": " "}, {"offsets": {"from": 2000, "to": 3001}, "text": "yo", "avg_logprob": -1.0}]}))
    got = R.read_transcripts(spark, str(tmp_path), 2).orderBy("id").collect()
    assert [(r["id"], r["start"], r["end"], r["text"], r["avg_logprob"]) for r in got] == [(1, 0.0, 1.23, "hi", -0.5), (3, 2.0, 3.0, "yo", -1.0)]


def test_findings(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"tool":"x","severity":"ERROR"},{"tool":"y"}]')
    (tmp_path / "b.json").write_text('{"tool":"z",\n "line": 3}')
    (tmp_path / "c.json").write_text('{"tool":"p"}\nnoise\n{"tool":"q"}\n')
    assert sorted(r["tool"] for r in R.read_findings(spark, str(tmp_path)).collect()) == ["p", "q", "x", "y", "z"]


def test_containers(spark, tmp_path):
    (tmp_path / "ps").write_text("c1|web|img|Up\nshort|row\nc2|db|img|Up\n")
    (tmp_path / "st").write_text("c1|12.5%|1.5GiB / 4GiB\n")
    ps, stats = R.read_container_stats(spark, str(tmp_path / "ps"), str(tmp_path / "st"))
    got = J.containers_with_stats(ps, stats).orderBy("container_id").collect()
    assert [(r["cpu"], r["memory_mb"]) for r in got] == [(12.5, 1536.0), (0.0, 0.0)]


def test_scale_config(spark):
    got = R.load_scale_config(spark, "web:2:9:70:30:5, web:1, api:x::80, :1").orderBy("service").collect()
    assert [(r["service"], r["min_replicas"], r["max_replicas"], r["cpu_up"], r["cpu_down"], r["interval_sec"]) for r in got] == [("api", 1, 5, 80.0, 20.0, 8), ("web", 2, 9, 70.0, 30.0, 5)]


def test_artifacts_and_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "k_a.mp4").write_bytes(b"12345")
    (tmp_path / "in" / "k_b.part").write_bytes(b"1")
    got = R.scan_artifacts(spark, str(tmp_path / "in")).orderBy("filename").collect()
    assert [(r["filename"], r["size"], r["partial"]) for r in got] == [("k_a.mp4", 5, False), ("k_b.part", 1, True)]
    events = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00', 1), ('a', TIMESTAMP '2024-01-01 00:01:00', 2) t(job_id, ts, percent)")
    R.write_job_state(events, str(tmp_path / "state"))
    row = spark.read.parquet(str(tmp_path / "state")).first()
    assert row["percent"] == 2 and str(row["expires_at"]) == "2024-01-01 02:01:00"


def test_golden(spark):
    cpu = A.cpu_metrics(spark.createDataFrame([("s", 90.0), ("s", 10.0), ("s", 10.0)], "service string, cpu double")).first()
    assert round(cpu["avg_cpu"], 1) == 36.7 and cpu["max_cpu"] == 90.0 and cpu["effective"] == 85.5
    values = spark.createDataFrame([(-1.6, 1), (-1.2, 0), (-2.55, 1), (1.2345, 2), (1.005, 2)], "x double, n int")
    got = [r[0] for r in values.select(F.when(F.col("n") == 0, S.round_half_away(F.col("x"), 0)).when(F.col("n") == 1, S.round_half_away(F.col("x"), 1)).otherwise(S.round_half_away(F.col("x"), 2))).collect()]
    assert got == [-1.6, -1.0, -2.6, 1.23, 1.0]
    counters = spark.createDataFrame([(500000, 0, 5000000, 0, 1), (1, 0, 5, 5, 1), (1, 2, 9, 5, 0)], "a long, b long, c long, d long, n int")
    assert [r[0] for r in counters.select(S.cpu_percent(*map(F.col, "abcdn"))).collect()] == [10.0, None, None]


def test_ewma_blocks_equal_fold(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("node"), F.col("id").alias("ts"), F.col("id").alias("event_id"), (F.rand(1) * 100).alias("duration_ms")).cache()
    got = {r["node"]: r["ewma"] for r in W.ewma_latency(df, block=7).collect()}
    for node in range(3):
        x = 15.0
        for r in df.where(F.col("node") == node).orderBy("ts").collect():
            x = 0.8 * x + 0.2 * r["duration_ms"]
        assert got[node] == pytest.approx(x)

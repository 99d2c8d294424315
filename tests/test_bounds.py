"""Operators whose work must not end, or grow in memory, at a bound."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import active_segment, span_tree
from tidemark.operators.windows import top2_margin
from tidemark.sources.readers import read_log_lines


def test_deep_spans(spark):
    rows = [("t", k, k - 1 if k else None) for k in range(14)] + [("t", 90, 91), ("u", 0, None), ("u", 1, 0)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id int, parent_span_id int")
    got = {(r["trace_id"], r["span_id"]): r["depth"] for r in span_tree(spans).collect()}
    assert got == {("t", k): k for k in range(14)} | {("t", 90): None, ("u", 0): 0, ("u", 1): 1}


def test_circle_of_spans_ends(spark):
    spans = spark.createDataFrame([("t", 0, None), ("t", 1, 0), ("t", 2, 1), ("t", 1, 2)], "trace_id string, span_id int, parent_span_id int")
    assert {r["span_id"] for r in span_tree(spans).where("depth IS NOT NULL").collect()} == {0, 1, 2}


def test_very_deep_spans_take_few_rounds(spark, monkeypatch):
    from tidemark.operators import joins

    rounds = []
    monkeypatch.setattr(joins, "written", lambda df, label, real=joins.written: rounds.append(label) or real(df, label))
    deep = spark.range(1000).select(F.lit("t").alias("trace_id"), F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_span_id"))
    around = spark.range(6).select(F.lit("c").alias("trace_id"), F.col("id").alias("span_id"), F.when(F.col("id") < 5, (F.col("id") + 1) % 4).otherwise(2).alias("parent_span_id"))
    got = span_tree(deep.union(around))
    assert len(rounds) <= 13
    assert got.where("trace_id = 't' AND depth <> span_id OR trace_id = 't' AND depth IS NULL").isEmpty() and got.where("trace_id = 'c' AND depth IS NOT NULL").isEmpty() and got.count() == 1006


@pytest.mark.parametrize("seconds", [1.0, 7.0, 1e6])
def test_segments_by_slices(spark, seconds):
    """Long pauses, equal starts and ends, times before all and after all: slices of any length give what a walk gives."""
    rnd = random.Random(3)
    segments = [("hot" if k % 9 else "cold", k, float(rnd.randrange(400)) / 2, None if k % 5 == 0 else float(rnd.randrange(500)) / 2, f"s{k}") for k in range(120)]
    times = [(m, float(rnd.randrange(-10, 520)) / 2) for m in ("hot", "cold", "none") for _ in range(150)]
    got = active_segment(spark.createDataFrame(times, "media_id string, t double").distinct(), spark.createDataFrame(segments, 'media_id string, id int, start double, `end` double, text string'), seconds=seconds)
    want = []
    for m, t in set(times):
        own = sorted((s for s in segments if s[0] == m), key=lambda s: (s[2], s[1]))
        begun = [i for i, s in enumerate(own) if s[2] <= t]
        text = None
        if begun:
            s = own[begun[-1]]
            until = own[begun[-1] + 1][2] if begun[-1] + 1 < len(own) else s[3] if s[3] is not None else s[2] + 3
            text = s[4] if t < until else None
        want.append((m, t, text))
    assert sorted(map(str, ((r["media_id"], r["t"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_log_lines_by_ranges(spark, tmp_path):
    """A file of many byte ranges has the lines and numbers that it has as a whole; a last line may end in a newline or not."""
    lines = [f"line {k} " + "x" * (k * 37 % 300) + "é" * (k % 3) for k in range(4000)]
    lines[100] = lines[2000] = ""
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("one\r\n\nthree")
    for size in ("128m", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_log_lines(spark, str(tmp_path))
            got = {f: [(r["pos"], r["line"]) for r in rows.orderBy("pos").collect() if r["file"].endswith(f)] for f in ("a.log", "b.log")}
            parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got["a.log"] == list(enumerate([*lines, ""])) and got["b.log"] == [(0, "one\r"), (1, ""), (2, "three")]
        assert size == "128m" or parts >= 7


def test_top2_gathers_two_rows(spark):
    rows = [("hot", k, float(k % 500)) for k in range(1000)] + [("one", 7, 2.0)]
    out = top2_margin(spark.createDataFrame(rows, "key string, label int, v double"), ["key"], "label", "v")
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("hot", 499, 499.0, 499.0, 0.0), ("one", 7, 2.0, 0.0, 2.0)]

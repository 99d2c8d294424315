"""Exact quantiles: what one aggregation gives is what distributed selection gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import quantiles as Q

POINTS = [0.0, 0.01, 0.5, 0.9, 0.95, 0.99, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    """Groups of one row, of one value, of ties, of widely spread values, of nulls; one with two thirds of all rows."""
    rnd = random.Random(8)
    groups = {
        "hot": [rnd.choice([rnd.random(), 5.0, -(10.0 ** rnd.randrange(-200, 200)), float(rnd.randrange(9))]) for _ in range(6000)],
        "same": [3.25] * 900,
        "ties": [float(rnd.randrange(3)) for _ in range(1500)],
        "line": [float(k) for k in range(601)],
        "one": [7.0],
        "two": [1.0, 2.0],
        "null": [None, None],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("two", None), (None, 1.5), (None, 2.5)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g string, v double").repartition(6).cache()


@pytest.mark.parametrize("kind", ["linear", "disc"])
def test_selection_is_aggregation(rows, kind, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 40)  # so that small groups need rounds, too
    want = {r["g"]: r["q"] for r in Q.quantiles(rows, ["g"], "v", POINTS, kind).collect()}
    got = {r["g"]: r["q"] for r in Q.quantiles(rows, ["g"], "v", POINTS, kind, most=0).collect()}
    assert got.keys() == want.keys() and got["null"] is None and want["null"] is None
    for g in want:
        if want[g] is not None:
            assert got[g] == pytest.approx(want[g], rel=1e-12), g


def test_floor_rank(rows):
    got = {r["g"]: r["value"] for r in A.floor_rank_percentile(rows, "g", 0.95, "v").collect()}
    values = {}
    for r in rows.where("v IS NOT NULL").collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert {g: v for g, v in got.items() if v is not None} == {g: sorted(v)[min(int(len(v) * 0.95), len(v) - 1)] for g, v in values.items()}


def test_reports_by_selection(rows, monkeypatch):
    """A1, A2, A19 and A32 give the same rows with groups too large for an aggregation."""
    monkeypatch.setattr(Q, "FEW", 100)
    plain = rows.where("g IS NOT NULL AND abs(v) < 1e6")
    timed = plain.withColumn("ts", F.timestamp_seconds(F.floor(F.abs("v") * 10).cast("long")))
    same = lambda a, b: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(a.collect())] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(b.collect())]
    assert same(A.cpu_metrics(plain, "g", "v"), A.cpu_metrics(plain, "g", "v", most=0))
    assert same(A.latency_report(timed, ["g"], "v").na.fill(0), A.latency_report(timed, ["g"], "v", most=0).na.fill(0))
    assert same(A.order_stats(plain, "g", "v").na.fill(0), A.order_stats(plain, "g", "v", most=0).na.fill(0))
    pictures = plain.select(F.xxhash64("g", "v").alias("image_id"), F.col("g").alias("kind"), "v").dropDuplicates(["image_id"])
    truth, found = pictures.select("image_id", "kind", F.lit(3).alias("true_cols"), F.lit(3).alias("true_rows")), pictures.select("image_id", F.lit(3).alias("cols"), F.lit(4).alias("rows"), F.col("v").alias("latency_ms"))
    assert same(A.detection_accuracy(truth, found), A.detection_accuracy(truth, found, most=0))

"""Rules over tiles with a halo: the same answers whatever the tile, on pictures of any shape, and few copies."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import refine as R
from tidemark.operators import tiles as T


def pictures(spark, missing=False):
    rnd = random.Random(6)
    rows = [(i, x, y, *(rnd.randrange(256) for _ in range(3)), rnd.randrange(3), rnd.random() * 5, rnd.random()) for i, (w, h) in enumerate([(23, 17), (1, 9), (12, 1), (30, 31), (1, 1)]) for x in range(w) for y in range(h)]
    if missing:
        rows = [r for r in rows if rnd.random() < 0.8]
    return spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, label int, rareness double, confidence double")


def values(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("rule", [R.saliency, R.protected_mask, lambda p, tile: R.detail_map(p, "r", tile), lambda p, tile: R.bilateral(p, tile=tile)])
def test_tiles_of_any_size(spark, rule):
    df = pictures(spark)
    want = values(rule(df, tile=256))
    assert len(want) == df.count()
    for tile in (5, 8):
        assert values(rule(df, tile=tile)) == want


def test_neighbours_by_hand(spark):
    """Brightness 10, 40, 0 in a row: the largest differences are 30, 40 and 40; a label alone among its neighbours is a detail."""
    df = spark.createDataFrame([(1, k, 0, float(v), k % 2, 3.0, 0.5) for k, v in enumerate((10, 40, 0))], "image_id int, x int, y int, v double, label int, rareness double, confidence double")
    assert [r["detail"] for r in R.detail_map(df).orderBy("x").collect()] == [30.0, 40.0, 40.0]
    wide = spark.createDataFrame([(1, x, y, int(x == 2 and y == 2), 3.0, 0.5) for x in range(5) for y in range(5)], "image_id int, x int, y int, label int, rareness double, confidence double")
    assert {(r["x"], r["y"]) for r in R.protected_mask(wide).where("protected").collect()} == {(2, 2), (0, 0), (0, 4), (4, 0), (4, 4)}


def test_missing_places_count_as_nothing(spark):
    df = pictures(spark, missing=True)
    got = values(R.detail_map(df, "r", 7))
    pixels = {(r["image_id"], r["x"], r["y"]): r["r"] for r in df.collect()}
    want = sorted((i, x, y, float(max(abs(pixels[i, x + a, y + b] - v) for a in (-1, 0, 1) for b in (-1, 0, 1) if (i, x + a, y + b) in pixels))) for (i, x, y), v in pixels.items())
    assert got == want


def test_few_copies(spark):
    pixels = spark.range(700 * 500).select(F.lit(1).alias("image_id"), (F.col("id") % 700).cast("int").alias("x"), F.floor(F.col("id") / 700).cast("int").alias("y"), F.lit(1.0).alias("v"))
    seen = spark.sparkContext.accumulator(0)

    def rule(around):
        seen.add(int(around.held.sum()))
        return {"v2": around.columns["v"]}

    assert T.over_tiles(pixels, ["v"], 1, rule, "v2 double").count() == 350_000
    assert seen.value <= 1.05 * 350_000

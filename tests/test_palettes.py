"""K-means palettes and restoring, on planted pictures: blocks of a few colours, with noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import palettes as K
from tidemark.plans import registry

COLORS = [(20, 20, 20), (220, 40, 40), (40, 200, 60), (240, 240, 230)]
SCHEMA = "image_id long, x int, y int, r int, g int, b int, a int"


def picture(spark, image=1, cells=5, step=4, noise=6, seed=1):
    draw = np.random.default_rng(seed)
    plan = draw.integers(0, len(COLORS), (cells, cells))
    rows = [(image, x, y, *[int(np.clip(c + draw.integers(-noise, noise + 1), 0, 255)) for c in COLORS[plan[y // step, x // step]]], 255) for x in range(cells * step) for y in range(cells * step)]
    return spark.createDataFrame(rows, SCHEMA), plan


def test_palette(spark):
    (row,) = K.kmeans_palette(picture(spark)[0], [4]).collect()
    assert all(min(max(abs(a - b) for a, b in zip(p, c)) for p in row["palette"]) < 3 for c in COLORS)
    assert row["rmse"] < 8 and row == K.kmeans_palette(picture(spark)[0], [4]).first()


def test_elbow(spark):
    fits = K.kmeans_palette(picture(spark)[0], [2, 3, 4, 6, 8])
    assert K.elbow_k(fits).first()["k"] == 4
    errors = [r["rmse"] for r in fits.orderBy("k").collect()]
    assert errors == sorted(errors, reverse=True)


@pytest.mark.parametrize("how", [K.restore])
def test_restore(spark, how):
    pixels, plan = picture(spark)
    clear = picture(spark, 2)[0].withColumn("a", F.lit(0))
    got = how(pixels.union(clear), K.kmeans_palette(pixels.union(clear), [4]), 4.0).collect()
    assert len(got) == plan.size and {r["image_id"] for r in got} == {1}
    assert all(max(abs(r[c] - COLORS[plan[r["cy"], r["cx"]]][k]) for k, c in enumerate("rgb")) < 8 and r["a"] == 255 for r in got)


def test_few_colors_and_none(spark):
    one = spark.createDataFrame([(1, x, y, 7, 8, 9, 255) for x in range(4) for y in range(4)], SCHEMA)
    (row,) = K.kmeans_palette(one, [4]).collect()
    assert row["palette"] == [[7.0, 8.0, 9.0]] and row["rmse"] == 0
    assert K.restore(one, K.kmeans_palette(one, [4]), 2.0).count() == 4
    assert K.kmeans_palette(one.limit(0), [4]).count() == 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_on_the_tables(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0

"""What operators shuffle or repeat: by their plans, and their results where slices, tiles and bands meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import grids as G
from tidemark.operators import palettes as K
from tidemark.operators import pixels as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_parsed_once(spark):
    payload = F.concat(F.lit('{"sub": "a'), "id", F.lit('", "firebase": {"sign_in_provider": "google.com"}}'))
    tokens = spark.range(1).select(F.concat(F.lit("h."), F.regexp_replace(F.base64(payload.cast("binary")), "[=\\r\\n]", ""), F.lit(".s")).alias("t"))
    claims = tokens.select(S.token_claims(F.col("t")).alias("c")).select("c.*")
    assert tuple(claims.first()) == ("a0", "a0@example.com", "google")
    assert plan(claims).count("from_json") == 1


def test_autocorrelation_over_slices(spark):
    """A profile of three slices with gaps: against pairs counted one by one, and no row for each lag of each place."""
    rnd = random.Random(3)
    line = {p: float(rnd.randint(0, 99)) for p in range(-40, 600) if p % 13}
    out = X.autocorr(spark.createDataFrame([(1, p, v) for p, v in line.items()], "k int, p int, v double"), "k", "p", "v", 20)
    mean = sum(line.values()) / len(line)
    c = [sum((v - mean) * (line[p + lag] - mean) for p, v in line.items() if p + lag in line) / (len(line) - lag) for lag in range(21)]
    assert {r["lag"]: r["acf"] for r in out.collect()} == {lag: pytest.approx(c[lag] / c[0], abs=1e-9) for lag in range(21)}
    assert "sequence(0" not in plan(out)


def test_phases_over_bands(spark):
    """Bands of three rows cut cells; missing pixels don't count; pixels meet no summed-area table."""
    rnd = random.Random(4)
    rows = [(1, x, y, *[rnd.randint(0, 255) for _ in range(3)]) for x in range(9) for y in range(11) if (x, y) != (8, 10)]
    pixels = spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int")
    out = G.phase_variances(pixels, 4.0, 4.0, [0.0, 2.0], [0.0, 2.0], band=3)
    cell = lambda p, k: sum(p >= at for at in (range(4, 12, 4) if k == 0 else range(2, 12, 4)))
    for r in out.collect():
        groups = {}
        for row in rows:
            groups.setdefault((cell(row[1], r["ix"]), cell(row[2], r["iy"])), []).append(row[3:])
        assert r["variance"] == pytest.approx(sum(np.var(np.array(g), 0).sum() * len(g) for g in groups.values()) / len(rows))
    assert out.count() == 4 and "Window" not in plan(out) and "Join" not in plan(out)


def test_palettes_share_starts(spark):
    """A start of few centres begins one of more; an image is one group for all ks."""
    rnd = np.random.default_rng(5)
    points, weight = rnd.integers(0, 256, (60, 3)).astype(float), rnd.integers(1, 9, 60).astype(float)
    each = [K.lloyd(points, weight, [k], 15, 3, 42)[0] for k in (2, 5, 9)]
    for (palette, error), (one, alone) in zip(K.lloyd(points, weight, [2, 5, 9], 15, 3, 42), each):
        assert (palette == one).all() and error == alone
    pixels = spark.createDataFrame([(1, x, 0, 40 * x, 0, 0, 255) for x in range(6)], "image_id int, x int, y int, r int, g int, b int, a int")
    fits = K.kmeans_palette(pixels, [2, 3])
    assert [(r["k"], len(r["palette"])) for r in fits.orderBy("k").collect()] == [(2, 2), (3, 3)]
    assert "explode" not in plan(fits)


def test_labels_over_tiles(spark):
    """Nearest colours and confidence against plain Python, in tiles of two places; the image without palette goes."""
    rnd = random.Random(6)
    lab = lambda: (rnd.random(), rnd.random() - 0.5, rnd.random() - 0.5)
    rows = [(i, x, y, lab()) for i in (1, 2) for x in range(5) for y in range(3)]
    colours = [lab() for _ in range(4)]
    kind = "struct<L:double,A:double,B:double>"
    out = K.lab_labels(spark.createDataFrame(rows, f"image_id int, x int, y int, lab {kind}"), spark.createDataFrame([(1, colours)], f"image_id int, palette array<{kind}>"), tile=2)
    got = {(r["x"], r["y"]): (r["label"], r["confidence"]) for r in out.collect()}
    assert len(got) == 15
    for i, x, y, c in rows[:15]:
        d = sorted(((c[0] - p[0]) ** 2 + 1.8 * (c[1] - p[1]) ** 2 + 1.8 * (c[2] - p[2]) ** 2, k) for k, p in enumerate(colours))
        assert got[x, y] == (d[0][1], pytest.approx(1 - (d[0][0] / d[1][0]) ** 0.5))
    assert "array_sort" not in plan(out)

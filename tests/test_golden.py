"""Rules that a query and its SQL could both misread: small cases whose results were worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import grids as G
from tidemark.operators import pixels as X
from tidemark.operators import ranking as L
from tidemark.operators import refine as R
from tidemark.operators import windows as W


def line(spark, values, key=1):
    return spark.createDataFrame([(key, p, float(v)) for p, v in enumerate(values)], "k int, pos int, v double")


def picture(spark, rows, image=1):
    """rows of (r, g, b, a) or of one number for red, opaque."""
    full = lambda p: p if isinstance(p, tuple) else (p, 0, 0, 255)
    return spark.createDataFrame([(image, x, y, *full(p)) for y, row in enumerate(rows) for x, p in enumerate(row)], "image_id int, x int, y int, r int, g int, b int, a int")


def test_divisors_of_a_step(spark):
    """Step 10: 1 and 2 divide it, 3, 4, 6, 8, 12 and 16 are further than 0.15 from a whole ratio."""
    steps = spark.createDataFrame([(1, 10.0, 90), (2, 12.0, 60), (3, 8.1, 20), (4, 0.4, 90)], "k int, step double, sure int")
    got = {}
    for r in L.divisor_candidates(steps, "k", "step", "sure").orderBy("k", "rank").collect():
        got.setdefault(r["k"], []).append((r["size"], r["confidence"]))
    assert got[1] == [(10, 90), (1, 70), (2, 70)]
    # 12 is its own primary; of 1, 2, 3, 4 and 6 at 50 (ten below 60) the smaller stay
    assert got[2] == [(12, 60), (1, 50), (2, 50), (3, 50), (4, 50)]
    # ratios 8.1, 4.05, 2.7, 2.025, 1.35: differences 0.1, 0.05, -, 0.025; ten below 20 is under the least of 15
    assert got[3] == [(8, 20), (1, 15), (2, 15), (4, 15)]
    # no primary for a step that rounds to 0; the ratios of the larger sizes are nearest to 0
    assert got[4] == [(16, 66), (12, 65), (8, 62), (6, 60), (4, 55)]


def test_equal_peaks_keep_the_later(spark):
    values = [0, 5, 0, 5, 0, 2, 0, 5, 5, 5, 0]
    peaks = lambda distance, height=0.0: sorted(r["peak"] for r in G.find_peaks(line(spark, values), "k", "pos", "v", height, distance).collect())
    assert peaks(1) == [1, 3, 5, 8] and peaks(1, 3.0) == [1, 3, 8]
    # 3 drives out 1 and 5; rounded up, 2.1 is 3
    assert peaks(3) == [3, 8] and peaks(2.1) == [3, 8] and peaks(2) == [1, 3, 5, 8]


@pytest.mark.parametrize("seed", [1, 2])
def test_peaks_apart_are_greedy(spark, seed):
    import random

    rnd = random.Random(seed)
    values = {k: [rnd.randrange(6) for _ in range(80)] for k in range(5)} | {9: [0, *[x for k in range(30) for x in (k + 1, 0)]]}
    df = spark.createDataFrame([(k, p, float(v)) for k, vs in values.items() for p, v in enumerate(vs)], "k int, pos int, v double")
    got = {}
    for r in G.find_peaks(df, "k", "pos", "v", 1.0, 5).collect():
        got.setdefault(r["k"], []).append(r["peak"])
    for k, vs in values.items():
        found, i = [], 1
        while i < len(vs) - 1:
            j = i
            while j + 1 < len(vs) and vs[j + 1] == vs[i]:
                j += 1
            if vs[i - 1] < vs[i] and j + 1 < len(vs) and vs[j + 1] < vs[i] and vs[i] >= 1:
                found.append((i + j) // 2)
            i = j + 1
        kept = []
        for p in sorted(found, key=lambda p: (-vs[p], -p)):
            if all(abs(p - q) >= 5 for q in kept):
                kept.append(p)
        assert sorted(got.get(k, [])) == sorted(kept)


def test_normalised_by_the_interior(spark):
    """100 at the edge counts neither; of 1, 0, 2, 0, 3 the P95 is 2.8; zeros count."""
    got = [r["norm"] for r in W.normalize_profile(line(spark, [100, 1, 0, 2, 0, 3, 90]), ["k"], "pos", "v").orderBy("pos").collect()]
    assert got == pytest.approx([1.5, 1 / 2.8, 0.0, 2 / 2.8, 0.0, 3 / 2.8, 1.5], abs=1e-6)
    # P95 of the interior is 0 with 30 zeros and one 7: the maximum is taken
    rare = [r["norm"] for r in W.normalize_profile(line(spark, [0.0, 7.0, *[0.0] * 30, 14.0]), ["k"], "pos", "v").orderBy("pos").collect()]
    assert rare[1] == pytest.approx(1.0, abs=1e-6) and rare[-1] == 1.5
    assert [r["norm"] for r in W.normalize_profile(line(spark, [4, 9]), ["k"], "pos", "v").orderBy("pos").collect()] == [4.0, 9.0]


def test_box_mean_repeats_the_edge(spark):
    got = [r["smooth"] for r in W.box_mean(line(spark, [100, 0, 0, 0, 0, 0, 0, 0, 7]), ["k"], "pos", "v").orderBy("pos").collect()]
    assert got == pytest.approx([400 / 7, 300 / 7, 200 / 7, 100 / 7, 0, 1, 2, 3, 4])
    assert [r["smooth"] for r in W.box_mean(line(spark, [5]), ["k"], "pos", "v").collect()] == [5.0]


def test_axis_profile_of_transparent_pixels(spark):
    """A clear white pixel is as dark as black: the step from it to opaque white is 255, not half of that."""
    rows = [[(255, 255, 255, 0), (255, 255, 255, 255), (0, 0, 0, 255)]]
    got = {r["pos"]: r["edge"] for r in X.axis_profile(picture(spark, rows)).collect()}
    assert got == {1: pytest.approx(255.0), 2: pytest.approx(255.0)}


def test_colour_count_of_faint_pixels(spark):
    faint = [[(x * 16, 0, 0, 100) for x in range(10)]]
    clear = [[(x * 16, 0, 0, 0) for x in range(10)]]
    both = picture(spark, faint).union(picture(spark, clear, 2))
    assert {r["image_id"]: r["k"] for r in X.adaptive_k(both, 2, 48, 0.05).collect()} == {1: 10, 2: 2}


def test_snapping_leaves_clear_colours(spark):
    got = X.snap_palette(picture(spark, [[(9, 8, 7, 31), (9, 8, 7, 32)]]), ((0, 0, 0), (255, 255, 255))).orderBy("x").collect()
    assert [tuple(r)[3:] for r in got] == [(9, 8, 7, 0), (0, 0, 0, 255)]


def test_snapping_of_equal_distances(spark):
    """(38, 168, 71) is 17,573.918 from black and from (200, 40, 40): the first of equals wins, though sums of doubles are a hair apart."""
    assert 299 * 38**2 + 587 * 168**2 + 114 * 71**2 == 299 * 162**2 + 587 * 128**2 + 114 * 31**2
    got = X.snap_palette(picture(spark, [[(38, 168, 71, 255)]]), ((0, 0, 0), (200, 40, 40))).first()
    assert tuple(got)[3:] == (0, 0, 0, 255)


def test_grid_variance_of_colours(spark):
    """Two cells of two pixels: red 0 and 10 with blue 10 and 0 have variance 25 + 25, although their brightness hardly differs."""
    rows = [[(0, 0, 10, 255), (10, 0, 0, 255), (4, 4, 4, 255), (4, 4, 4, 255)]]
    assert G.grid_variance(picture(spark, rows), 2.0, 1.0).first()["variance"] == pytest.approx(25.0)
    # lines at 0.5 and 2.5 are rounded to even places, 0 and 2; the last cell has one pixel
    assert G.grid_variance(picture(spark, [[0, 10, 30, 30, 50]]), 2.0, 1.0, (0.5, 0.0)).first()["variance"] == pytest.approx((2 * 25 + 0 + 0) / 5)


def test_best_phase_down_before_across(spark):
    flat = picture(spark, [[7] * 6 for _ in range(6)])
    assert tuple(G.best_phase(flat, 3.0, 3.0, 3).first()) == (1, 0.0, 0.0, 0.0)
    # columns change at 1 and 4, so the offset across is 1; rows are alike, so down it is 0
    rows = [[0, 9, 9, 9, 5, 5]] * 6
    assert tuple(G.best_phase(picture(spark, rows), 3.0, 2.0, 3).first()) == (1, 1.0, 0.0, 0.0)


def test_contrast_limits(spark):
    rows = [[(x // 3 + y // 3) % 2 * 200 for x in range(24)] for y in range(24)]
    contrast = lambda step, p=picture(spark, rows): G.phase_contrast(p, step).first()["contrast"]
    # at step 3 the best phase has no variance at all: (worst - 0) / (variance / 20) is large; over 24 / 3 and under 1.5 there is none
    assert contrast(3.0) > 5 and contrast(9.0) == 0.0 and contrast(1.4) == 0.0
    assert contrast(3.0, picture(spark, [[5] * 24] * 24)) == 0.0


def test_comb_phase_is_refined(spark):
    """Steps of 8: teeth at 3 with half as much at 4: the best of 32 phases is 3, its neighbours 2.75 and 3.25 have 0.75 and 0.875 of it."""
    values = [4.0 if p % 8 == 3 else 2.0 if p % 8 == 4 else 0.0 for p in range(64)]
    row = G.comb_phase(line(spark, values), "k", "pos", "v", 8.0).first()
    lo, best, hi = 3.0, 4.0, 3.5
    assert row["phase"] == pytest.approx(3 + 0.5 * (lo - hi) / (lo - 2 * best + hi) * 0.25, abs=1e-6)
    # the mean over phases of two triangles of heights 4 and 2 is 6 / 8
    assert row["strength"] == pytest.approx(4 / (6 / 8), rel=1e-6)
    short = G.comb_phase(line(spark, values[:20]), "k", "pos", "v", 8.0).first()
    assert (short["phase"], short["strength"]) == (0.0, 0.0) and G.comb_phase(line(spark, values), "k", "pos", "v", 1.2).first()["strength"] == 0.0


def test_rayleigh_of_a_lattice(spark):
    """Equal peaks at 5, 13, 21, ... 61: R is 1, n_eff 8, and 8 of int(63 / 8) - 1 = 6 slots are met, at most all: sqrt(16) = 4."""
    values = [1.0 if p % 8 == 5 else 0.0 for p in range(64)]
    got = {r["step"]: r["score"] for r in G.rayleigh(line(spark, values), "k", "pos", "v", [8.0, 1.9, 16.0, 12.0]).collect()}
    assert got[8.0] == pytest.approx(4.0) and got[1.9] == 0.0 and got[16.0] == 0.0
    # at 12 the angles of 5 + 8 k go round in thirds: 8 of them leave one beside two full turns and one pair
    turn = [complex(math.cos(2 * math.pi * p / 12), math.sin(2 * math.pi * p / 12)) for p in range(5, 64, 8)]
    assert got[12.0] <= math.sqrt(16) * abs(sum(turn)) / 8 + 1e-9
    few = [1.0 if p in (5, 13, 21, 29) else 0.0 for p in range(64)]
    assert G.rayleigh(line(spark, few), "k", "pos", "v", [8.0]).first()["score"] == 0.0


def test_histogram_takes_zero(spark):
    values = spark.createDataFrame([("a", v) for v in (0.0, 0.1, 64.0, 64.1, -1.0)], "k string, v double")
    assert {r["bin"]: r["n"] for r in A.uniform_histogram(values, "k", "v").collect()} == {0: 2, 128: 1}


def test_no_step_of_few_runs(spark):
    scores = spark.createDataFrame([("a", float(s), 1.0 if s == 8 else 0.1) for s in range(3, 20)], "k string, step double, score double")
    runs = lambda n: spark.createDataFrame([("a", 8.0)] * n, "k string, v double")
    assert G.pick_peak_step(scores, runs(49), "k", "v").count() == 0 and G.pick_peak_step(scores, runs(50), "k", "v").first()["step"] == 8.0


def test_gateway_timeouts_are_no_server_errors(spark):
    rows = [(k, k, s, True, False, 1.0) for k, s in enumerate((200, 500, 502, 503, 504, 501, 400))]
    got = A.audit_summary(spark.createDataFrame(rows, "id int, ts int, status int, safe boolean, crashed boolean, memory_mb double")).first()
    assert (got["server_errors"], got["clean"], got["blocked"]) == (3, 1, 1)


def test_cores_are_whole_pixels(spark):
    """Ten places in three cells: 0-2, 3-5, 6-9; a quarter of 3 is 0, of 4 it is 1."""
    got = R.whole_core(picture(spark, [[0] * 10] * 4), 3, 1).where("y = 1").orderBy("x").collect()
    assert [r["cx"] for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert [r["core"] for r in got] == [True] * 6 + [False, True, True, False]
    assert not any(r["core"] for r in R.whole_core(picture(spark, [[0] * 10] * 4), 3, 1).where("y = 0 OR y = 3").collect())


def test_span_names(spark):
    rows = [("GET", "/api/info", 200, False), ("POST", "/api/cancel/7", 500, False), ("GET", "/x", 404, False), ("PUT", "/y", 201, False), ("GET", "/.env", 403, True)]
    df = spark.createDataFrame(rows, "m string, p string, s int, probe boolean")
    got = [r[0] for r in df.select(S.span_name(F.col("m"), F.col("p"), F.col("s"), F.col("probe"))).collect()]
    assert got == ["🌐 [Gateway] Lấy thông tin Media (/api/info)", "🌐 [Gateway] Hủy tiến trình (/api/cancel/7)", "🌐 [Gateway] Lỗi 404 (GET /x)", "🌐 [Gateway] PUT /y", "🛡️ [Security Probe] GET /.env (HTTP 403)"]


def test_counter_rates_at_one_instant(spark):
    """Samples of one instant go by their number: 0 to 4 at once is infinitely fast, 4 to 4 is no number, 4 to 10 in 2 s is 3 a second."""
    rows = [(1, 3, "2024-01-01 00:00:00", 4), (1, 1, "2024-01-01 00:00:00", 0), (1, 2, "2024-01-01 00:00:00", 4), (1, 4, "2024-01-01 00:00:02", 10)]
    samples = spark.createDataFrame(rows, "k int, n int, t string, c long").withColumn("t", F.to_timestamp("t"))
    got = [r["c_rate"] for r in W.counter_rates(samples, ["k"], "t", ["c"], ["n"]).collect()]
    assert got[:2] == [None, math.inf] and math.isnan(got[2]) and got[3] == 3.0


def test_offset_of_over_a_cell(spark):
    """Four places in four cells, an offset of 2.5: modulo the cell that is half a place; whole, only the last place is past the first line."""
    one = picture(spark, [[0, 0, 0, 0]])
    cells = lambda **how: [r["cx"] for r in X.spatial_grid(one, 4, 1, (2.5, 0.0), **how).orderBy("x").collect()]
    assert cells() == [0, 0, 1, 2]
    assert cells(wraps=False) == [0, 0, 0, 0]


def test_best_phase_of_an_exact_tie(spark):
    """By fractions the least variance is 1885.8359375, half a unit of the sixth place, and goes up."""
    rows = [[(5 * x * x + x * y * 5) % 256 for x in range(8)] for y in range(8)]
    assert tuple(G.best_phase(picture(spark, rows), 2.5, 2.0, 4).first()) == (1, 1.875, 1.0, 1885.835938)


def test_median_without_a_corner(spark):
    """Of the eight values that are there the median is the mean of the middle two."""
    one = picture(spark, [[1, 2, 3], [17, 18, 40], [41, 42, 43]]).where("NOT (x = 0 AND y = 0)")
    got = {(r["x"], r["y"]): r["smooth"] for r in X.median_quantised(one, "r").collect()}
    # 2, 3, 17, 18, 40, 41, 42, 43: (18 + 40) / 2 = 29 is 2.4 steps; 40 alone would be 3.3
    assert got[1, 1] == 24.0 and len(got) == 8

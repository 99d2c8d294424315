"""Queries of the grid operators: proposals come from parts, profiles from vectors, pixels from triples of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import grids as G

from .pixel_queries import SQL, pixels
from .table_queries import PROFILE, profile, read, rounded

C = F.col


def proposals(spark, d):
    """Four detectors a part; they agree more or less."""
    p = read(spark, d, "part").select(C("p_partkey").alias("image_id"), C("p_size").alias("s"), F.explode(F.array(*map(F.lit, range(4)))).alias("detector"))
    off = C("detector") * (C("image_id") % 4)
    return p.select("image_id", "detector", (C("s") + 20 + off).cast("int").alias("cols"), (C("s") + 20 + F.floor(off / 2)).cast("int").alias("rows"), F.when(C("image_id") % 9 == 0, 3.0).otherwise(1.0).alias("aspect"))


PROPOSALS = """pr AS (SELECT p_partkey AS image_id, detector, (p_size + 20 + detector * (p_partkey % 4))::INT AS cols, (p_size + 20 + floor(detector * (p_partkey % 4) / 2))::INT AS rows_, CASE WHEN p_partkey % 9 = 0 THEN 3.0 ELSE 1.0 END AS aspect FROM part, (VALUES (0), (1), (2), (3)) v(detector)),
    ag AS (SELECT a.*, b.cols AS cols2, b.rows_ AS rows2, b.detector AS other FROM pr a JOIN pr b ON a.image_id = b.image_id AND abs(a.cols - b.cols) <= greatest(1, 0.01 * greatest(a.cols, b.cols)) AND abs(a.rows_ - b.rows_) <= greatest(1, 0.01 * greatest(a.rows_, b.rows_)))"""

def comb_sql(step: float, places: int = 64) -> str:
    """A22 over the profile of 64 places, phase by phase."""
    bins = max(8, round(step * 4))
    return f"""WITH p AS {PROFILE}, t AS (SELECT bin, least(floor(tp), {places} - 2)::BIGINT AS lo, tp FROM (SELECT bin, bin * ({step} / {bins}::DOUBLE) + k * {step}::DOUBLE AS tp FROM range({bins}) r(bin), range({places}) s(k)) WHERE tp <= {places} - 2),
        m AS (SELECT a.vec_id, bin, round(avg(a.v * (1 - (tp - lo)) + b.v * (tp - lo)), 9) AS m FROM t JOIN p a ON a.pos = lo JOIN p b ON b.vec_id = a.vec_id AND b.pos = lo + 1 GROUP BY 1, 2),
        b AS (SELECT vec_id, arg_max(bin, (m, -bin)) AS bin, max(m) AS m, sum(m) / {bins} AS mean FROM m GROUP BY 1),
        s AS (SELECT b.*, l.m AS lo, h.m AS hi FROM b JOIN m l ON l.vec_id = b.vec_id AND l.bin = (b.bin + {bins} - 1) % {bins} JOIN m h ON h.vec_id = b.vec_id AND h.bin = (b.bin + 1) % {bins}),
        f AS (SELECT vec_id, (bin + CASE WHEN abs(lo - 2 * m + hi) > 1e-12 THEN greatest(-1, least(1, 0.5 * (lo - hi) / (lo - 2 * m + hi))) ELSE 0 END) * ({step} / {bins}::DOUBLE) AS tp, m / (mean + 1e-9) AS strength FROM s)
        SELECT vec_id, round(tp - floor(tp / {step}) * {step}::DOUBLE, 5) AS phase, round(strength, 5) AS strength FROM f"""


def phases_sql(table: str, image: str, step_x: float, step_y: float, tries: int) -> str:
    """SQL of pv: the variance of r, g and b in the cells of each phase; lattice lines are rounded, a pixel's cell is the count of lines up to it."""
    cuts = lambda size, step: f"list_distinct(list_prepend(0, list_transform(range(0, ceil(({size} + {step} - i * {step} / {tries}::DOUBLE) / {step})::INT), lambda j: least(greatest(round_even(i * ({step} / {tries}::DOUBLE) + j * {step}::DOUBLE, 0), 0), {size})::INT)))"
    return f"""sz AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {image} GROUP BY 1),
        cx AS (SELECT image_id, i AS ix, {cuts('w', step_x)} AS xs FROM sz, range({tries}) r(i)), cy AS (SELECT image_id, i AS iy, {cuts('h', step_y)} AS ys FROM sz, range({tries}) r(i)),
        ax AS (SELECT image_id, ix, p AS x, len(list_filter(xs, lambda q: q <= p)) AS gx FROM cx, range({table}) r(p)), ay AS (SELECT image_id, iy, p AS y, len(list_filter(ys, lambda q: q <= p)) AS gy FROM cy, range({table}) r(p)),
        ce AS (SELECT i.image_id, iy, ix, count(*) AS n, sum(r * r + g * g + b * b) AS q, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM {image} i JOIN ax ON ax.image_id = i.image_id AND ax.x = i.x JOIN ay ON ay.image_id = i.image_id AND ay.y = i.y GROUP BY i.image_id, iy, ix, gy, gx),
        pv AS (SELECT image_id, iy, ix, sum((q / n::DOUBLE - pow(r / n::DOUBLE, 2) - pow(g / n::DOUBLE, 2) - pow(b / n::DOUBLE, 2)) * n) / sum(n) AS variance FROM ce GROUP BY 1, 2, 3)"""


def best_sql(step_x: float, step_y: float, tries: int) -> str:
    return f"""SELECT image_id, round(ix * ({step_x} / {tries}::DOUBLE), 6) AS ox, round(iy * ({step_y} / {tries}::DOUBLE), 6) AS oy, near AS variance
        FROM (SELECT *, round(variance, 6) AS near, row_number() OVER (PARTITION BY image_id ORDER BY round(variance, 6), iy, ix) AS k FROM pv) WHERE k = 1"""


def greedy_sql(peaks: str, keys: str, distance: str) -> str:
    """SQL of kept: of peaks (keys, pos, h) those that stay when the highest, of equals the last, drives out what is nearer than distance."""
    on = " AND ".join(f"z.{k} = q.{k}" for k in keys.split(", "))
    mine = ", ".join(f"z.{k}" for k in keys.split(", "))
    return f"""pq AS (SELECT *, {distance} AS d, row_number() OVER (PARTITION BY {keys} ORDER BY h DESC, pos DESC) AS k FROM {peaks}),
        z AS (SELECT {keys}, 0::BIGINT AS k, []::DOUBLE[] AS held FROM (SELECT DISTINCT {keys} FROM pq)
          UNION ALL SELECT {mine}, q.k, CASE WHEN len(list_filter(z.held, lambda o: abs(o - q.pos) < q.d)) = 0 THEN list_append(z.held, q.pos::DOUBLE) ELSE z.held END FROM z JOIN pq q ON {on} AND q.k = z.k + 1),
        kept AS (SELECT q.* FROM (SELECT {keys}, arg_max(held, k) AS held FROM z GROUP BY ALL) z JOIN pq q ON {on} AND list_contains(z.held, q.pos::DOUBLE))"""


QUERIES = {
    "j12_agreeing_pairs": (lambda s, d: G.agreeing_pairs(proposals(s, d)).select("image_id", "detector", "other"), f"WITH {PROPOSALS} SELECT image_id, detector, other FROM ag"),
    "u5_grid_consensus": (
        lambda s, d: G.grid_consensus(proposals(s, d)),
        f"""WITH {PROPOSALS}, g AS (SELECT image_id, aspect, detector, cols, rows_, count(*) AS n, floor(median(cols2))::INT AS mc, floor(median(rows2))::INT AS mr FROM ag GROUP BY ALL),
        k AS (SELECT *, CASE WHEN n >= 3 AND abs(ln(mc::DOUBLE / mr / aspect)) < 0.35 THEN 0 WHEN n >= 2 THEN 1 ELSE 2 END AS kind FROM g),
        b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY kind, CASE WHEN kind = 0 THEN -n ELSE 0 END, detector) AS r FROM k)
        SELECT image_id, CASE WHEN kind = 0 THEN mc ELSE cols END AS cols, CASE WHEN kind = 0 THEN mr ELSE rows_ END AS rows, ['vote', 'pair', 'single'][kind + 1] AS consensus FROM b WHERE r = 1""",
    ),
    "a27_lattice": (
        lambda s, d: rounded(G.lattice_z(profile(s, d), "vec_id", "pos", "v"), 5),
        f"SELECT vec_id, round((o - m) / s - greatest((f - m) / s, 0), 5) AS z FROM (SELECT vec_id, avg(v) FILTER (pos % 8 = 0) AS o, avg(v) FILTER (pos % 8 = 4) AS f, avg(v) AS m, stddev_pop(v) AS s FROM {PROFILE} GROUP BY vec_id)",
    ),
    "a22_comb_phase": (lambda s, d: rounded(G.comb_phase(profile(s, d), "vec_id", "pos", "v", 8.0), 5), comb_sql(8.0)),
    "a21_best_phase": (lambda s, d: rounded(G.best_phase(pixels(s, d), 2.5, 2.0, 4), 6), f"WITH {SQL}, {phases_sql('8', 'px', 2.5, 2.0, 4)} {best_sql(2.5, 2.0, 4)}"),
    "a20_grid_variance": (
        lambda s, d: rounded(G.grid_variance(pixels(s, d), 2.0, 3.0), 6),
        f"WITH {SQL}, {phases_sql('8', 'px', 2.0, 3.0, 1)} SELECT image_id, round(variance, 6) AS variance FROM pv",
    ),
    "a26_rayleigh": (
        lambda s, d: rounded(G.rayleigh(profile(s, d), "vec_id", "pos", "v", [1.5, 4.0, 6.5, 12.0, 20.0]), 5),
        f"""WITH RECURSIVE p AS {PROFILE}, sc AS (SELECT vec_id, quantile_cont(v, 0.95) AS q, max(v) AS t FROM p WHERE pos BETWEEN 1 AND 62 GROUP BY 1),
        nm AS (SELECT p.vec_id, pos, greatest(0, least(1.5, v / (CASE WHEN q > 0 THEN q WHEN t > 0 THEN t ELSE 1 END + 1e-9))) AS v FROM p JOIN sc USING (vec_id) WHERE pos BETWEEN 1 AND 62),
        rn AS (SELECT vec_id, any_value(v) AS h, min(pos) AS a, max(pos) AS b, run FROM (SELECT *, sum(CASE WHEN v = pv THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY pos) AS pv FROM nm)) GROUP BY vec_id, run),
        pk AS (SELECT vec_id, step, (a + b) // 2 AS pos, h FROM (SELECT *, lag(h) OVER w AS l, lead(h) OVER w AS r FROM rn WINDOW w AS (PARTITION BY vec_id ORDER BY run)), (VALUES (4.0::DOUBLE), (6.5), (12.0)) t(step) WHERE h >= 0.15 AND l < h AND r < h),
        {greedy_sql('pk', 'vec_id, step', 'greatest(floor(step * 0.4), 1)')},
        su AS (SELECT vec_id, step, sum(h * cos(2 * pi() * pos / step)) AS re, sum(h * sin(2 * pi() * pos / step)) AS im, sum(h) AS h, sum(h * h) AS hh FROM kept GROUP BY 1, 2 HAVING count(*) >= 5),
        ph AS (SELECT *, atan2(im, re) / (2 * pi()) * step - floor(atan2(im, re) / (2 * pi())) * step AS phase FROM su),
        sl AS (SELECT ph.vec_id, ph.step, count(DISTINCT round_even((pos - phase) / ph.step, 0)) FILTER (abs(pos - phase - round_even((pos - phase) / ph.step, 0) * ph.step) < 0.35 * ph.step) AS slots FROM ph JOIN kept ON kept.vec_id = ph.vec_id AND kept.step = ph.step GROUP BY 1, 2)
        SELECT v.vec_id, t.step, round(coalesce(sqrt(2 * h * h / hh) * sqrt(re * re + im * im) / h * least(slots / greatest(floor(63 / t.step) - 1, 1), 1), 0), 5) AS score
        FROM (SELECT DISTINCT vec_id FROM p) v CROSS JOIN (VALUES (1.5::DOUBLE), (4.0), (6.5), (12.0), (20.0)) t(step) LEFT JOIN ph ON ph.vec_id = v.vec_id AND ph.step = t.step LEFT JOIN sl ON sl.vec_id = v.vec_id AND sl.step = t.step""",
    ),
    "a18_pick_step": (
        lambda s, d: G.pick_step(rounded(A.comb_scores(A.uniform_histogram(read(s, d, "events"), "event_type", "value"), "event_type", [4, 6, 8, 16])), "event_type"),
        "WITH h AS (SELECT event_type, (least(floor(value / 64.0 * 129), 128) + 0.5) * 64 / 129 AS c FROM events WHERE value >= 0 AND value <= 64), s AS (SELECT event_type, step, round(avg(cos(2 * pi() * c / step)), 6) AS score FROM h, (VALUES (4.0::DOUBLE), (6.0), (8.0), (16.0)) v(step) GROUP BY 1, 2) SELECT event_type, max(step) AS step FROM (SELECT *, max(score) OVER (PARTITION BY event_type) AS top FROM s) WHERE score >= 0.7 * top GROUP BY 1",
    ),
    "w11_find_peaks": (
        lambda s, d: G.find_peaks(profile(s, d), "vec_id", "pos", "v", 100.0, 1),
        f"""WITH p AS {PROFILE}, g AS (SELECT *, sum(CASE WHEN v = pv THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY pos) AS pv FROM p)),
        r AS (SELECT vec_id, run, any_value(v) AS v, min(pos) AS a, max(pos) AS b FROM g GROUP BY vec_id, run)
        SELECT vec_id, ((a + b) // 2)::BIGINT AS peak, v AS height FROM (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY run)) WHERE v >= 100 AND before < v AND after < v""",
    ),
}

"""Queries of the refinements over cells and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pixels as X
from tidemark.operators import refine as R
from tidemark.operators.pixels import luma

from .pixel_queries import CELL_MAX, LUMA, SQL, cell_colors, cells, far, gates_of, lab_of, pixels
from .table_queries import PROFILE, profile, rounded

C = F.col


def shares(spark, d):
    n = cells(spark, d).groupBy("image_id", "cx", "cy", "label").agg(F.count("*").alias("n"))
    every = n.groupBy("image_id", "cx", "cy").agg(F.sum("n").alias("all_"))
    return n.join(every, ["image_id", "cx", "cy"]).select("image_id", "cx", "cy", "label", (C("n") / C("all_")).alias("p"))


def masked(spark, d):
    return pixels(spark, d).select("image_id", "x", "y", F.floor(C("r") / 64).cast("int").alias("label"), (C("g") / 20.0).alias("rareness"), (C("b") / 255.0).alias("confidence"))


#: One round of gated relaxation: sh{k} from {of}, by gates ow (nx, ny, g; the g of a cell sum to 1).
ROUND = """c{k} AS (SELECT image_id, cx, cy, max(p) - coalesce(max(p) FILTER (r = 2), 0) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cx, cy ORDER BY p DESC, label) AS r FROM {of}) GROUP BY 1, 2, 3),
    m{k} AS (SELECT ow.image_id, ow.cx, ow.cy, a.label, sum(ow.g * a.p) AS m FROM ow JOIN {of} a ON a.image_id = ow.image_id AND a.cx = ow.nx AND a.cy = ow.ny GROUP BY 1, 2, 3, 4),
    sh{k} AS (SELECT image_id, cx, cy, label, CASE WHEN count(m) OVER (PARTITION BY image_id, cx, cy) = 0 THEN p ELSE coalesce(p, 0) * (1 - 0.35 * pow(1 - conf, 2)) + coalesce(m, 0) * 0.35 * pow(1 - conf, 2) END AS p FROM {of} FULL JOIN m{k} USING (image_id, cx, cy, label) JOIN c{k} USING (image_id, cx, cy))"""
OPEN = "ow AS (SELECT image_id, cx, cy, cx + dx AS nx, cy + dy AS ny, g / sum(g) OVER (PARTITION BY image_id, cx, cy) AS g FROM (SELECT *, CASE WHEN dx = 0 OR dy = 0 THEN 1.0::DOUBLE ELSE 0.707 END * gate AS g FROM gt) WHERE g > 1e-6)"

LINEAR = ", ".join(f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END AS l{c}" for c in "rgb")

QUERIES = {
    "i1_saliency": (
        lambda s, d: rounded(R.saliency(pixels(s, d)), 4),
        f"""WITH {SQL}, {lab_of('px', 'image_id, x, y')}, sz AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM px GROUP BY 1), o9 AS (SELECT a.v AS dx, b.v AS dy FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)),
        nr AS (SELECT p.image_id, p.x, p.y, dx, dy, p.l, p.a, p.b, least(greatest(p.x + dx, 0), mx) AS ox, least(greatest(p.y + dy, 0), my) AS oy FROM lab_px p JOIN sz USING (image_id), o9),
        ag AS (SELECT n.image_id, n.x, n.y, max({far('n', 'o')}) AS d, max(sqrt(n.a * n.a + n.b * n.b)) AS c, sum(dx * (2 - abs(dy)) * o.l) AS gx, sum(dy * (2 - abs(dx)) * o.l) AS gy, avg(o.l) AS s, avg(o.l * o.l) AS q FROM nr n JOIN lab_px o ON o.image_id = n.image_id AND o.x = n.ox AND o.y = n.oy GROUP BY 1, 2, 3),
        sc AS (SELECT image_id, x, y, least(d * 100, 10) * (0.5 + 2 * c) AS rareness, least(sqrt(gx * gx + gy * gy) * 4, 10) AS edge, least(greatest(q - s * s, 0) * 50, 10) AS variance FROM ag)
        SELECT image_id, x, y, round(rareness, 4) AS rareness, round(edge, 4) AS edge, round(variance, 4) AS variance, round(1 + rareness * 1.5 + edge * 0.5 + variance * 0.3, 4) AS weight FROM sc""",
    ),
    "i2_protected_mask": (
        lambda s, d: R.protected_mask(masked(s, d)),
        f"""WITH {SQL} SELECT p.image_id, p.x, p.y, max(p.g) / 20.0 > 2 AND max(p.b) / 255.0 > 0.3 AND count(*) FILTER (p.r // 64 = o.r // 64) BETWEEN 1 AND 4 AS protected
        FROM px p JOIN px o ON p.image_id = o.image_id AND abs(p.x - o.x) <= 1 AND abs(p.y - o.y) <= 1 GROUP BY 1, 2, 3""",
    ),
    "i4_relax_labels": (
        lambda s, d: rounded(R.relax_labels(shares(s, d), X.edge_gates(cell_colors(s, d).select("image_id", "cx", "cy", X.to_oklab(C("r"), C("g"), C("b")).alias("lab")))), 6),
        f"WITH {CELL_MAX}, {lab_of('cm')}, {gates_of('lab_cm')}, {OPEN}, t AS (SELECT image_id, cx, cy, label, count(*) AS n FROM pc GROUP BY ALL), sh0 AS (SELECT image_id, cx, cy, label, n::DOUBLE / sum(n) OVER (PARTITION BY image_id, cx, cy) AS p FROM t), {ROUND.format(k=1, of='sh0')}, {ROUND.format(k=2, of='sh1')} SELECT image_id, cx, cy, label, round(p, 6) AS p FROM sh2",
    ),
    "i8_detail_map": (
        lambda s, d: rounded(R.detail_map(pixels(s, d).select("image_id", "x", "y", luma(C("r"), C("g"), C("b")).alias("v"))), 4),
        f"WITH {SQL}, l AS (SELECT image_id, x, y, {LUMA} AS v FROM px) SELECT p.image_id, p.x, p.y, round(max(abs(p.v - o.v)), 4) AS detail FROM l p JOIN l o ON p.image_id = o.image_id AND abs(p.x - o.x) <= 1 AND abs(p.y - o.y) <= 1 GROUP BY 1, 2, 3",
    ),
    "i9_grid_cuts": (
        lambda s, d: R.grid_cuts(profile(s, d), "vec_id", "pos", "v", 8.0),
        f"""WITH p AS {PROFILE}, m AS (SELECT vec_id, avg(v) AS mean, max(pos) AS last FROM p GROUP BY 1), e AS (SELECT vec_id, mean, unnest(range(0, floor(last / 8)::INT + 1))::INT AS cut FROM m),
        n AS (SELECT vec_id, round_even(pos / 8.0, 0)::INT AS cut, pos, v, row_number() OVER (PARTITION BY vec_id, round_even(pos / 8.0, 0) ORDER BY v DESC, pos) AS k FROM p WHERE abs(pos - round_even(pos / 8.0, 0) * 8) <= 2.8)
        SELECT e.vec_id, e.cut, CASE WHEN n.v >= 0.5 * mean THEN n.pos::DOUBLE ELSE e.cut * 8.0::DOUBLE END AS at FROM e LEFT JOIN n ON e.vec_id = n.vec_id AND e.cut = n.cut AND n.k = 1""",
    ),
}

"""Queries over pixels made from vectors: three consecutive vectors are one 8 x 8 image, a level for each number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pixels as X
from tidemark.operators.ranking import distinct_colors

from .table_queries import PROFILE, profile, read, rounded

C = F.col
PALETTE = ((0, 0, 0), (255, 255, 255), (200, 40, 40), (40, 90, 200))


def pixels(spark, d):
    v = read(spark, d, "embeddings").select(F.floor(C("vec_id") / 3).alias("image_id"), (C("vec_id") % 3).alias("band"), F.posexplode("embedding").alias("pos", "x"))
    level = F.floor(F.least(F.abs(C("x").cast("double")) * 1000, F.lit(255.0))).cast("int")
    v = v.select("image_id", (C("pos") % 8).alias("x"), F.floor(C("pos") / 8).cast("int").alias("y"), "band", level.alias("v"))
    band = lambda k: F.max(F.when(C("band") == k, C("v")))
    out = v.groupBy("image_id", "x", "y").agg(*[F.coalesce(band(k), F.lit(0)).alias(c) for k, c in enumerate("rgb")])
    return out.withColumn("a", F.when((C("x") + C("y")) % 5 == 0, 0).when((C("x") + C("y")) % 5 == 1, 100).otherwise(255))


SQL = """px AS (SELECT *, CASE WHEN (x + y) % 5 = 0 THEN 0 WHEN (x + y) % 5 = 1 THEN 100 ELSE 255 END AS a FROM (
    SELECT vec_id // 3 AS image_id, (pos % 8)::INT AS x, (pos // 8)::INT AS y, coalesce(max(v) FILTER (vec_id % 3 = 0), 0) AS r, coalesce(max(v) FILTER (vec_id % 3 = 1), 0) AS g, coalesce(max(v) FILTER (vec_id % 3 = 2), 0) AS b
    FROM (SELECT vec_id, pos, floor(least(abs(e::DOUBLE) * 1000, 255))::INT AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)) GROUP BY 1, 2, 3))"""
LUMA = "(0.299 * r + 0.587 * g + 0.114 * b)::DOUBLE"
CELLS = f"""{SQL}, pc AS (SELECT *, floor((x + 0.5) / 2)::INT AS cx, floor((y + 0.5) / 2)::INT AS cy, greatest(0.05, (1 - 2 * abs((x + 0.5) / 2 - floor((x + 0.5) / 2) - 0.5)) * (1 - 2 * abs((y + 0.5) / 2 - floor((y + 0.5) / 2) - 0.5)))::DOUBLE AS w, (r // 64)::INT AS label FROM px)"""
FEATURES = f"""{CELLS}, s AS (SELECT image_id, cx, cy, label, sum(w) AS w FROM pc WHERE a > 10 GROUP BY ALL), p AS (SELECT *, round(w / sum(w) OVER (PARTITION BY image_id, cx, cy), 9) AS p FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY image_id, cx, cy ORDER BY p DESC, label) AS rank FROM p),
    ft AS (SELECT image_id, cx, cy, max(label) FILTER (rank = 1) AS label, max(p) AS p1, coalesce(max(p) FILTER (rank = 2), 0) AS p2 FROM k GROUP BY ALL)"""


def cells(spark, d):
    return X.assign_cells(pixels(spark, d), 2.0).withColumn("label", F.floor(C("r") / 64).cast("int"))


def cell_colors(spark, d):
    p = cells(spark, d)
    return p.groupBy("image_id", "cx", "cy").agg(*[F.max(c).alias(c) for c in "rgb"])


CELL_MAX = f"{CELLS}, cm AS (SELECT image_id, cx, cy, max(r) AS r, max(g) AS g, max(b) AS b FROM pc GROUP BY ALL)"


def lab_of(name: str, key: str = "image_id, cx, cy") -> str:
    """SQL of lab_{name}: the OKLab colours (l, a, b) of a table's r, g, b."""
    linear = ", ".join(f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END AS l{c}" for c in "rgb")
    return f"""lin_{name} AS (SELECT *, {linear} FROM {name}), lms_{name} AS (SELECT *, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS u, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS m, cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS s FROM lin_{name}),
    lab_{name} AS (SELECT {key}, 0.2104542553 * u + 0.7936177850 * m - 0.0040720468 * s AS l, 1.9779984951 * u - 2.4285922050 * m + 0.4505937099 * s AS a, 0.0259040371 * u + 0.7827717662 * m - 0.8086757660 * s AS b FROM lms_{name})"""


def far(p: str, o: str) -> str:
    return f"(pow({p}.l - {o}.l, 2) + 1.8 * pow({p}.a - {o}.a, 2) + 1.8 * pow({p}.b - {o}.b, 2))"


def gates_of(name: str) -> str:
    """SQL of gt: the gates between neighbouring cells of a table with l, a, b."""
    return f"""g0 AS (SELECT p.image_id, p.cx, p.cy, o.cx - p.cx AS dx, o.cy - p.cy AS dy, exp(-5 * sqrt({far('p', 'o')})) AS g FROM {name} p JOIN {name} o ON p.image_id = o.image_id AND abs(p.cx - o.cx) <= 1 AND abs(p.cy - o.cy) <= 1 AND (p.cx <> o.cx OR p.cy <> o.cy)),
    gt AS (SELECT g0.image_id, g0.cx, g0.cy, g0.dx, g0.dy, CASE WHEN g0.dx = 0 OR g0.dy = 0 THEN g0.g ELSE g0.g * greatest(h.g, v.g) END AS gate FROM g0 LEFT JOIN g0 h ON h.image_id = g0.image_id AND h.cx = g0.cx AND h.cy = g0.cy AND h.dx = g0.dx AND h.dy = 0 LEFT JOIN g0 v ON v.image_id = g0.image_id AND v.cx = g0.cx AND v.cy = g0.cy AND v.dx = 0 AND v.dy = g0.dy)"""


#: td: the labels of wn (label, confidence, l, a, b) after the clean-up, with shares sh (label, p).
TIDY = f"""nb AS (SELECT c.image_id, c.cx, c.cy, o.cx AS ox, o.cy AS oy, o.label AS vote, o.l, o.a, o.b FROM wn c JOIN wn o ON c.image_id = o.image_id AND abs(c.cx - o.cx) + abs(c.cy - o.cy) = 1),
    nc AS (SELECT image_id, cx, cy, vote, count(*) AS n, sum(count(*)) OVER (PARTITION BY image_id, cx, cy) AS sides FROM nb GROUP BY 1, 2, 3, 4),
    pr AS (SELECT p.image_id, p.cx, p.cy, p.vote, avg({far('p', 'o')}) AS d FROM nb p JOIN nb o ON p.image_id = o.image_id AND p.cx = o.cx AND p.cy = o.cy AND p.vote = o.vote AND (p.ox, p.oy) < (o.ox, o.oy) GROUP BY 1, 2, 3, 4),
    fl AS (SELECT nc.image_id, nc.cx, nc.cy, nc.vote FROM nc JOIN pr ON nc.image_id = pr.image_id AND nc.cx = pr.cx AND nc.cy = pr.cy AND nc.vote = pr.vote WHERE n >= 3 AND sides = 4 AND sqrt(d) < 0.15),
    td AS (SELECT w.image_id, w.cx, w.cy, CASE WHEN f.vote <> w.label AND (coalesce(o.p, 0) < 0.7 OR w.confidence < 0.45 OR coalesce(v.p, 0) / greatest(coalesce(o.p, 0), 1e-4) > 0.35) THEN f.vote ELSE w.label END AS label
      FROM wn w LEFT JOIN fl f ON f.image_id = w.image_id AND f.cx = w.cx AND f.cy = w.cy LEFT JOIN sh o ON o.image_id = w.image_id AND o.cx = w.cx AND o.cy = w.cy AND o.label = w.label LEFT JOIN sh v ON v.image_id = w.image_id AND v.cx = w.cx AND v.cy = w.cy AND v.label = f.vote)"""


def labelled(spark, d):
    return cell_colors(spark, d).select("image_id", "cx", "cy", F.floor(C("r") / 128).cast("int").alias("label"), (C("g") % 64 / 64.0).alias("confidence"), X.to_oklab(C("r"), C("g"), C("b")).alias("lab"))


def quarter_shares(spark, d):
    return cell_colors(spark, d).select("image_id", "cx", "cy", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(p).alias("p")) for k, p in ((0, 0.75), (1, 0.25))])).alias("s")).select("image_id", "cx", "cy", "s.*")


QUERIES = {
    "f22_luma": (
        lambda s, d: rounded(pixels(s, d).select("image_id", "x", "y", X.luma(C("r"), C("g"), C("b"), C("a")).alias("grey"), X.luma(C("r"), C("g"), C("b"), C("a"), "times").alias("times"))),
        f"WITH {SQL} SELECT image_id, x, y, round({LUMA} * a / 255.0 + 127.5 * (1 - a / 255.0), 6) AS grey, round({LUMA} * a / 255.0, 6) AS times FROM px",
    ),
    "f22_oklab": (
        lambda s, d: rounded(pixels(s, d).select("image_id", "x", "y", X.to_oklab(C("r"), C("g"), C("b")).alias("c")).select("image_id", "x", "y", "c.L"), 5),
        f"""WITH {SQL}, l AS (SELECT *, {', '.join(f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END AS l{c}" for c in 'rgb')} FROM px)
        SELECT image_id, x, y, round(0.2104542553 * cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) + 0.7936177850 * cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) - 0.0040720468 * cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb), 5) AS "L" FROM l""",
    ),
    "f23_color_bin": (lambda s, d: pixels(s, d).groupBy(X.color_bin(C("r"), C("g"), C("b")).alias("bin")).agg(F.count("*").alias("n")), f"WITH {SQL} SELECT ((r >> 4) * 256 + (g >> 4) * 16 + (b >> 4))::INT AS bin, count(*) AS n FROM px GROUP BY 1"),
    "a12_adaptive_k": (
        lambda s, d: X.adaptive_k(pixels(s, d), 4, 48, 0.05),
        f"WITH {SQL}, c AS (SELECT image_id, count(*) AS n FROM px WHERE a > 0 GROUP BY image_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4)), t AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS s FROM c) SELECT image_id, greatest(4, least(48, count(*) FILTER (n / s >= 0.05)))::INT AS k FROM t GROUP BY image_id",
    ),
    "a13_axis_profile": (
        lambda s, d: rounded(X.axis_profile(pixels(s, d)), 4),
        f"WITH {SQL}, l AS (SELECT *, {LUMA} * a / 255.0 AS v FROM px) SELECT image_id, x AS pos, round(sum(abs(v - p)), 4) AS edge FROM (SELECT *, lag(v) OVER (PARTITION BY image_id, y ORDER BY x) AS p FROM l) WHERE p IS NOT NULL GROUP BY 1, 2",
    ),
    "a14_cell_features": (
        lambda s, d: rounded(X.cell_features(cells(s, d)), 6),
        f"WITH {FEATURES} SELECT image_id, cx, cy, label, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p1 - p2, 6) AS confidence FROM ft",
    ),
    "a16_cell_color": (
        lambda s, d: X.cell_color(cells(s, d), cells(s, d).groupBy("image_id", "cx", "cy").agg(F.max("label").alias("label"))).select("image_id", "cx", "cy", "a", "r"),
        f"WITH {CELLS}, m AS (SELECT image_id, cx, cy, max(label) AS label FROM pc GROUP BY ALL) SELECT pc.image_id, pc.cx, pc.cy, CASE WHEN count(*) FILTER (a > 127) * 2 > count(*) THEN 255 ELSE 0 END AS a, round_even(round((sum(w * r) FILTER (pc.label = m.label) / sum(w) FILTER (pc.label = m.label))::DOUBLE, 6), 0)::INT AS r FROM pc JOIN m ON pc.image_id = m.image_id AND pc.cx = m.cx AND pc.cy = m.cy GROUP BY 1, 2, 3",
    ),
    "a23_color_moments": (
        lambda s, d: X.color_moments(pixels(s, d)),
        f"WITH {SQL} SELECT image_id, ((r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3))::INT AS bin, count(*) AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, sum(r * r + g * g + b * b)::BIGINT AS squares FROM px WHERE a > 0 GROUP BY 1, 2",
    ),
    "a28_autocorrelation": (
        lambda s, d: rounded(X.autocorr(profile(s, d), "vec_id", "pos", "v", 12), 5),
        f"WITH p AS (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY vec_id) AS v, count(*) OVER (PARTITION BY vec_id) AS n FROM {PROFILE}), c AS (SELECT a.vec_id, b.pos - a.pos AS lag, sum(a.v * b.v) / (max(a.n) - (b.pos - a.pos)) AS c FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.pos - a.pos BETWEEN 0 AND 12 GROUP BY 1, b.pos - a.pos) SELECT vec_id, lag::INT AS lag, round(c / max(c) FILTER (lag = 0) OVER (PARTITION BY vec_id), 5) AS acf FROM c",
    ),
    "a29_flat_background": (
        lambda s, d: X.remove_flat_background(pixels(s, d)).select("image_id", "x", "y", "a"),
        f"WITH {SQL}, c AS (SELECT image_id, avg(r) AS r0, avg(g) AS g0, avg(b) AS b0 FROM px WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY 1) SELECT px.image_id, x, y, CASE WHEN abs(r - r0) <= 30 AND abs(g - g0) <= 30 AND abs(b - b0) <= 30 THEN 0 ELSE a END AS a FROM px JOIN c ON px.image_id = c.image_id",
    ),
    "a30_edge_sharpness": (
        lambda s, d: rounded(X.edge_sharpness(pixels(s, d)), 4),
        f"""WITH {SQL}, l AS (SELECT image_id, x, y, {LUMA} AS v FROM px), g AS (SELECT image_id,
          CASE WHEN lag(v) OVER h IS NULL THEN lead(v) OVER h - v WHEN lead(v) OVER h IS NULL THEN v - lag(v) OVER h ELSE (lead(v) OVER h - lag(v) OVER h) / 2 END AS gx,
          CASE WHEN lag(v) OVER k IS NULL THEN lead(v) OVER k - v WHEN lead(v) OVER k IS NULL THEN v - lag(v) OVER k ELSE (lead(v) OVER k - lag(v) OVER k) / 2 END AS gy
          FROM l WINDOW h AS (PARTITION BY image_id, y ORDER BY x), k AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, round(avg(sqrt(gx * gx + gy * gy)), 4) AS sharpness FROM g GROUP BY 1""",
    ),
    "j9_snap_palette": (
        lambda s, d: X.snap_palette(pixels(s, d), PALETTE),
        f"WITH {SQL}, q AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(PALETTE))}) v(i, pr, pg, pb)), n AS (SELECT px.*, pr, pg, pb, row_number() OVER (PARTITION BY image_id, x, y ORDER BY (0.299 * (r - pr) * (r - pr) + 0.587 * (g - pg) * (g - pg) + 0.114 * (b - pb) * (b - pb))::DOUBLE, i) AS k FROM px, q) SELECT image_id, x, y, CASE WHEN a < 32 THEN r ELSE pr END AS r, CASE WHEN a < 32 THEN g ELSE pg END AS g, CASE WHEN a < 32 THEN b ELSE pb END AS b, CASE WHEN a < 32 THEN 0 ELSE 255 END AS a FROM n WHERE k = 1",
    ),
    "j10_neighbors": (
        lambda s, d: X.neighbors3x3(pixels(s, d), "r").groupBy("image_id", "x", "y").agg(F.count("*").alias("n"), F.max("other").alias("top")),
        f"WITH {SQL} SELECT p.image_id, p.x, p.y, count(*) AS n, max(o.r) AS top FROM px p JOIN px o ON p.image_id = o.image_id AND abs(p.x - o.x) <= 1 AND abs(p.y - o.y) <= 1 GROUP BY 1, 2, 3",
    ),
    "j11_assign_cells": (lambda s, d: rounded(cells(s, d).select("image_id", "x", "y", "cx", "cy", "w")), f"WITH {CELLS} SELECT image_id, x, y, cx, cy, round(w, 6) AS w FROM pc"),
    "u3_distinct_colors": (lambda s, d: distinct_colors(pixels(s, d)), f"WITH {SQL} SELECT DISTINCT image_id, r, g, b FROM px WHERE a > 0"),
    "i3_edge_gates": (
        lambda s, d: rounded(X.edge_gates(cell_colors(s, d).select("image_id", "cx", "cy", X.to_oklab(C("r"), C("g"), C("b")).alias("lab")))),
        f"WITH {CELL_MAX}, {lab_of('cm')}, {gates_of('lab_cm')} SELECT image_id, cx, cy, dx, dy, round(gate, 6) AS gate FROM gt",
    ),
    "i5_tv_cleanup": (
        lambda s, d: X.tv_cleanup(labelled(s, d), quarter_shares(s, d)).select("image_id", "cx", "cy", "label"),
        f"WITH {CELL_MAX}, {lab_of('cm')}, wn AS (SELECT c.image_id, c.cx, c.cy, (c.r // 128)::INT AS label, c.g % 64 / 64.0 AS confidence, l.l, l.a, l.b FROM cm c JOIN lab_cm l USING (image_id, cx, cy)), sh AS (SELECT image_id, cx, cy, unnest([0, 1]) AS label, unnest([0.75::DOUBLE, 0.25]) AS p FROM cm), {TIDY} SELECT image_id, cx, cy, label FROM td",
    ),
}


"""Queries of palettes, votes, superpixels and restoring. What k-means feeds has no SQL; its tests are by planted pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import palettes as K
from tidemark.operators import pixels as X
from tidemark.operators import refine as R

from .pixel_queries import CELLS, SQL, cells, pixels
from .refine_queries import LINEAR
from .table_queries import rounded

C = F.col
KS = [4, 8, 12, 16]


def voters(spark, d):
    return cells(spark, d).withColumns({"confidence": C("b") / 255.0, "protected": C("g") > 120, "core": (C("x") + C("y")) % 2 == 0})


def labs(spark, d):
    return pixels(spark, d).select("image_id", "x", "y", X.to_oklab(C("r"), C("g"), C("b")).alias("lab"))


def fitted(spark, d, k=8):
    return K.kmeans_palette(pixels(spark, d), [k])


LAB = f"""{SQL}, lin AS (SELECT image_id, x, y, {LINEAR} FROM px), lms AS (SELECT image_id, x, y, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS l, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS m, cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS s FROM lin),
    lab AS (SELECT image_id, x, y, 0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s AS l, 1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s AS a, 0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s AS b FROM lms)"""

VOTE_STEPS = """vs AS (SELECT image_id, cx, cy, label, sum((w + 1e-4) * (0.5 + 0.5 * b / 255.0) * CASE WHEN g > 120 THEN 2.5 ELSE 1 END)::DOUBLE AS v FROM pc GROUP BY ALL),
    vt AS (SELECT image_id, cx, cy, arg_max(label, y * 1000 + x) AS veto FROM pc WHERE g > 120 GROUP BY ALL),
    vr AS (SELECT *, row_number() OVER (PARTITION BY image_id, cx, cy ORDER BY v DESC, label) AS k FROM vs LEFT JOIN vt USING (image_id, cx, cy)),
    vc AS (SELECT image_id, cx, cy, max(v) FILTER (k = 1) AS v1, coalesce(max(v) FILTER (k = 2), 0) AS v2, max(label) FILTER (k = 1) AS l1, max(veto) AS veto, max(v) FILTER (label = veto) AS vv, sum(v) AS al FROM vr GROUP BY ALL),
    vp AS (SELECT *, coalesce(vv >= 0.08 * al, false) AS protected FROM vc), vm AS (SELECT *, CASE WHEN protected THEN vv ELSE v1 END / al AS share FROM vp),
    vo AS (SELECT image_id, cx, cy, CASE WHEN protected THEN veto ELSE l1 END AS label, share - v2 / al AS margin, protected, protected OR (share - v2 / al >= 0.35 AND share >= 0.48) AS confident FROM vm)"""
VOTES = f"{CELLS}, {VOTE_STEPS}"

HEAT = """f{k} AS (SELECT * FROM fx UNION ALL SELECT * FROM {of}),
    t{k} AS (SELECT o.image_id, o.cx, o.cy, a.label, sum(a.p * CASE WHEN o.cx = a.cx OR o.cy = a.cy THEN 1.0::DOUBLE ELSE 0.707 END) AS m FROM f{k} a JOIN lo o ON a.image_id = o.image_id AND abs(a.cx - o.cx) <= 1 AND abs(a.cy - o.cy) <= 1 AND (a.cx <> o.cx OR a.cy <> o.cy) GROUP BY 1, 2, 3, 4),
    u{k} AS (SELECT image_id, cx, cy, label, m / sum(m) OVER (PARTITION BY image_id, cx, cy) AS m FROM t{k}),
    e{k} AS (SELECT image_id, cx, cy, label, exp((1.5 * coalesce(p, 0) + 1.2 * coalesce(m, 0)) / {heat}) AS e FROM {of} FULL JOIN u{k} USING (image_id, cx, cy, label)),
    q{k} AS (SELECT image_id, cx, cy, label, e / sum(e) OVER (PARTITION BY image_id, cx, cy) AS p FROM e{k})"""



def refinement(core: str, of: str = "pc") -> str:
    """SQL of ce and nn: the votes vo after two rounds, and what their neighbours have. core: the rule of core pixels of the table `of`."""
    return f"""lo AS (SELECT image_id, cx, cy FROM vo WHERE NOT confident AND NOT protected), fx AS (SELECT image_id, cx, cy, label, 1.0::DOUBLE AS p FROM vo WHERE confident OR protected),
        q0 AS (SELECT image_id, cx, cy, label, sum(n) / sum(sum(n)) OVER (PARTITION BY image_id, cx, cy) AS p FROM (SELECT image_id, cx, cy, label, CASE WHEN {core} THEN 2.0::DOUBLE ELSE 0.5 END AS n FROM {of} SEMI JOIN lo USING (image_id, cx, cy)) GROUP BY 1, 2, 3, 4),
        {HEAT.format(k=1, of='q0', heat=0.7)}, {HEAT.format(k=2, of='q1', heat=0.4)},
        be AS (SELECT image_id, cx, cy, label AS better, p FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cx, cy ORDER BY p DESC, label) AS r FROM q2) WHERE r = 1),
        ce AS (SELECT image_id, cx, cy, coalesce(better, label) AS label, coalesce(p, 1) AS p, confident, protected FROM vo LEFT JOIN be USING (image_id, cx, cy)),
        nn AS (SELECT a.image_id, a.cx, a.cy, b.label AS near, count(*) AS n, sum(count(*)) OVER (PARTITION BY a.image_id, a.cx, a.cy) AS al FROM ce a JOIN ce b ON a.image_id = b.image_id AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1 GROUP BY 1, 2, 3, 4)"""


REFINED = "CASE WHEN near IS NOT NULL AND NOT protected AND (NOT confident OR p < 0.7) THEN near ELSE label END"
REFINED_FROM = "ce LEFT JOIN (SELECT * FROM nn WHERE n >= 3 AND al = 4) USING (image_id, cx, cy)"

SLIC = """d{k} AS (SELECT p.image_id, x, y, p.l, p.a, p.b, c.cx, c.cy, round(pow(p.l - c.l, 2) + 1.8 * pow(p.a - c.a, 2) + 1.8 * pow(p.b - c.b, 2) + 196.0::DOUBLE * (pow(x - mx, 2) + pow(y - my, 2)), 9) AS d FROM lab p JOIN c{k} c ON p.image_id = c.image_id AND abs(x - least((cx + 0.5) * 2, 7)) <= 2.3 AND abs(y - least((cy + 0.5) * 2, 7)) <= 2.3 AND abs(x // 2 - cx) <= 1 AND abs(y // 2 - cy) <= 1),
    o{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY d, cy, cx) AS r FROM d{k}) WHERE r = 1),
    w{k} AS (SELECT image_id, cx, cy, avg(x) AS ox, avg(y) AS oy, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM o{k} GROUP BY ALL),
    c{next} AS (SELECT c.image_id, cx, cy, coalesce(least((cx + 0.5) * 2, 7) + 0.12 * greatest(-0.3, least(0.3, ox - least((cx + 0.5) * 2, 7))), mx)::DOUBLE AS mx, coalesce(least((cy + 0.5) * 2, 7) + 0.12 * greatest(-0.3, least(0.3, oy - least((cy + 0.5) * 2, 7))), my)::DOUBLE AS my, coalesce(w.l, c.l) AS l, coalesce(w.a, c.a) AS a, coalesce(w.b, c.b) AS b FROM c{k} c LEFT JOIN w{k} w USING (image_id, cx, cy))"""

QUERIES = {
    "a15_cell_vote": (
        lambda s, d: rounded(R.cell_vote(voters(s, d)), 6),
        f"WITH {VOTES} SELECT image_id, cx, cy, label, round(margin, 6) AS margin, protected, confident FROM vo",
    ),
    "i6_refine_ambiguous": (
        lambda s, d: R.refine_ambiguous(R.cell_vote(voters(s, d)), voters(s, d)).select("image_id", "cx", "cy", "label", "confident"),
        f"WITH {VOTES}, {refinement('(x + y) % 2 = 0')} SELECT image_id, cx, cy, {REFINED} AS label, confident FROM {REFINED_FROM}",
    ),
    "i8_bilateral": (
        lambda s, d: rounded(R.bilateral(pixels(s, d)), 5),
        f"""WITH {LAB}, w AS (SELECT p.image_id, p.x, p.y, exp(-(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) / 8 - (pow(p.l - o.l, 2) + 1.8 * pow(p.a - o.a, 2) + 1.8 * pow(p.b - o.b, 2)) / 0.0128) AS w, o.l, o.a, o.b FROM lab p JOIN lab o ON p.image_id = o.image_id AND abs(p.x - o.x) <= 2 AND abs(p.y - o.y) <= 2)
        SELECT image_id, x, y, round(sum(w * l) / sum(w), 5) AS "L", round(sum(w * a) / sum(w), 5) AS "A", round(sum(w * b) / sum(w), 5) AS "B" FROM w GROUP BY 1, 2, 3""",
    ),
    "i7_grid_slic": (
        lambda s, d: R.grid_slic(labs(s, d), 4, 4, 8, 8),
        f"""WITH {LAB}, c1 AS (SELECT image_id, a.cx, b.cy, least((a.cx + 0.5) * 2, 7)::DOUBLE AS mx, least((b.cy + 0.5) * 2, 7)::DOUBLE AS my, l, lab.a, lab.b FROM (VALUES (0), (1), (2), (3)) a(cx), (VALUES (0), (1), (2), (3)) b(cy), lab WHERE x = floor(least((a.cx + 0.5) * 2, 7) + 0.5) AND y = floor(least((b.cy + 0.5) * 2, 7) + 0.5)),
        {', '.join(SLIC.format(k=k, next=k + 1) for k in range(1, 5))} SELECT image_id, x, y, cx, cy FROM o4""",
    ),
    "a24_kmeans_palette": (lambda s, d: fitted(s, d), None),
    "a25_elbow_k": (lambda s, d: K.elbow_k(K.kmeans_palette(pixels(s, d), KS)), None),
}

"""Fixed-round refinements over cells and pixels: each round is one join and one aggregation, for many images at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import made_since, mark, release, written

from .pixels import oklab_dist2, to_oklab
from .tiles import TILE, Around, over_tiles


def with_confidence(shares: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, confidence): each cell's best label, the smaller of equals, and its share less the second."""
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("p"), "label"))).where("rank <= 2")
    lead = F.max("p") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("p"))), F.lit(0.0))
    return ranked.groupBy(*key).agg(F.min_by("label", "rank").alias("label"), F.least(F.greatest(lead, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def relax_labels(cells: DataFrame, gates: DataFrame, rounds: int = 2, pull: float = 0.35) -> DataFrame:
    """I4: labels of cells (image_id, cx, cy, label, p), p the share of each label, drawn towards their neighbours.

    In each round a cell's shares move by pull (1 - confidence)^2 towards the mean of its neighbours' shares, straight
    neighbours weighing 1 and diagonal ones 0.707, times their gate (edge_gates); gates that weigh no more than 1e-6 are
    shut, and a cell with none open keeps its shares. confidence is the best share less the second. A round is a written
    table, so plans don't grow with the rounds."""
    key = ["image_id", "cx", "cy"]
    weight = F.when((F.col("dx") == 0) | (F.col("dy") == 0), 1.0).otherwise(0.707) * F.col("gate")
    open_ = gates.select(*key, (F.col("cx") + F.col("dx")).alias("nx"), (F.col("cy") + F.col("dy")).alias("ny"), weight.alias("g")).where("g > 1e-6")
    total = F.sum("g").over(Window.partitionBy(*key))
    begun = mark()
    open_ = written(open_.withColumn("g", F.col("g") / total), "relax-gates")
    for _ in range(rounds):
        sure = with_confidence(cells, key).select(*key, "confidence")
        other = cells.select("image_id", F.col("cx").alias("nx"), F.col("cy").alias("ny"), "label", F.col("p").alias("q"))
        came = open_.join(other, ["image_id", "nx", "ny"]).groupBy(*key, "label").agg(F.sum(F.col("g") * F.col("q")).alias("m"))
        step = F.lit(pull) * F.pow(1 - F.col("confidence"), F.lit(2.0))
        both = cells.join(came, [*key, "label"], "full").join(sure, key)
        alone = F.max("m").over(Window.partitionBy(*key)).isNull()
        p = F.when(alone, F.col("p")).otherwise(F.coalesce("p", F.lit(0.0)) * (1 - step) + F.coalesce("m", F.lit(0.0)) * step)
        cells = written(both.select(*key, "label", p.alias("p")), "relax-round")
    release(cells.sparkSession, made_since(begun, but_last=True))
    return cells


def saliency(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """How much each pixel stands out, in the OKLab colours of the 3 x 3 around it, edges replicated.

    rareness: the largest squared distance to a neighbour, times 100, at most 10, times (0.5 + 2 chroma). edge: the length of the
    Sobel gradient of L, times 4, at most 10. variance: that of L, times 50, at most 10. weight: 1 + 1.5 rareness +
    0.5 edge + 0.3 variance. Pictures are worked on in tiles with a halo."""

    def rule(around: Around) -> dict[str, np.ndarray]:
        light, a, b = (around.repeated(c) for c in "LAB")
        far, gx, gy, total, squares = (np.zeros(around.shape) for _ in range(5))
        for dx, dy in around.shifts():
            own = light(dx, dy)
            d = [own - light(0, 0), a(dx, dy) - a(0, 0), b(dx, dy) - b(0, 0)]
            far = np.maximum(far, d[0] * d[0] + 1.8 * d[1] * d[1] + 1.8 * d[2] * d[2])
            gx, gy = gx + dx * (2 - abs(dy)) * own, gy + dy * (2 - abs(dx)) * own
            total, squares = total + own, squares + own * own
        ten = lambda v: np.minimum(v, 10.0)
        chroma = np.sqrt(a(0, 0) ** 2 + b(0, 0) ** 2)
        rareness, edge = ten(far * 100) * (0.5 + 2 * chroma), ten(np.sqrt(gx * gx + gy * gy) * 4)
        variance = ten(np.maximum(squares / 9 - (total / 9) ** 2, 0.0) * 50)
        return {"rareness": rareness, "edge": edge, "variance": variance, "weight": 1 + rareness * 1.5 + edge * 0.5 + variance * 0.3}

    return over_tiles(_lab(pixels), list("LAB"), 1, rule, "rareness double, edge double, variance double, weight double", tile)


def _lab(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "x", "y", to_oklab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).select("image_id", "x", "y", "lab.L", "lab.A", "lab.B")


def protected_mask(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Small details: rareness over 2, confidence over 0.3, and one to four pixels of the same label in the 3 x 3 around, itself counted."""

    def rule(around: Around) -> dict[str, np.ndarray]:
        label = around.clipped("label")
        same = sum((other == label(0, 0)[0]) & there for other, there in (label(dx, dy) for dx, dy in around.shifts()))
        return {"protected": (around.columns["rareness"] > 2) & (around.columns["confidence"] > 0.3) & (same >= 1) & (same <= 4)}

    return over_tiles(pixels, ["label", "rareness", "confidence"], 1, rule, "protected boolean", tile)


def detail_map(pixels: DataFrame, value: str = "v", tile: int = TILE) -> DataFrame:
    """I8: the largest difference of brightness to the neighbours."""

    def rule(around: Around) -> dict[str, np.ndarray]:
        near = around.clipped(value)
        detail = np.zeros(around.shape)
        for dx, dy in around.shifts():
            other, there = near(dx, dy)
            detail = np.maximum(detail, np.where(there, np.abs(other - near(0, 0)[0]), 0.0))
        return {"detail": detail}

    return over_tiles(pixels, [value], 1, rule, "detail double", tile)


def grid_cuts(profile: DataFrame, key: str, pos: str, value: str, step: float, reach: float = 0.35) -> DataFrame:
    """For each place of a uniform grid the strongest edge within reach of it, if it is at least half as strong as the mean edge; else the place.

    Each profile place knows the only cut that it can belong to, so this is one aggregation."""
    mean = profile.groupBy(key).agg(F.avg(value).alias("mean_"), F.max(pos).alias("last_"))
    cut = F.bround(F.col(pos) / step)
    near = profile.where(F.abs(F.col(pos) - cut * step) <= reach * step).groupBy(key, cut.cast("int").alias("cut")).agg(F.max_by(F.struct(F.col(pos).alias("at"), F.col(value).alias("edge")), F.struct(F.col(value), -F.col(pos))).alias("b"))
    every = mean.select(key, "mean_", F.explode(F.sequence(F.lit(0), F.floor(F.col("last_") / step).cast("int"))).alias("cut"))
    strong = F.col("b.edge") >= 0.5 * F.col("mean_")
    return every.join(near, [key, "cut"], "left").select(key, "cut", F.when(strong, F.col("b.at").cast("double")).otherwise(F.col("cut") * step).alias("at"))


def elastic_cuts(profile: DataFrame, limits: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, cut, at) for cut 0 to cells: the places where an image of limits (key, size, cells, origin) is cut.

    A cut is the strongest edge (the first of equals) within max(2, 0.35 steps) of its place on the uniform grid from origin, if that
    edge is at least half as strong as the mean one; else that place. Each leaves room for the cuts before and after it.
    profile: edge strengths at the places between pixels, 1 to size - 1. An image without profile is cut uniformly."""
    mean = profile.groupBy(key).agg(F.avg(value).alias("mean_"))
    every = limits.join(mean, key, "left").withColumn("step_", F.col("size") / F.col("cells")).select("*", F.explode(F.sequence(F.lit(0), F.col("cells"))).alias("cut"))
    target = F.col("origin") + F.col("cut") * F.col("step_")
    reach = F.greatest(0.35 * F.col("step_"), F.lit(2.0))
    last = F.col("size") - (F.col("cells") - F.col("cut"))
    within = lambda c: F.least(F.greatest(c, F.col("cut")), last)
    rows = every.withColumns({"low_": F.greatest(F.floor(target - reach), F.col("cut")), "high_": F.least(F.ceil(target + reach), last), "plain_": within(_rounded(target)), "even_": F.least(_rounded(F.col("cut") * F.col("step_")), F.col("size"))})
    seen = rows.where("low_ <= high_").select(key, "cut", F.explode(F.sequence("low_", "high_")).alias(pos)).join(profile.select(key, F.col(pos).cast("long").alias(pos), F.col(value).alias("edge_")), [key, pos])
    best = seen.groupBy(key, "cut").agg(F.max(F.struct("edge_", (-F.col(pos)).alias("p"))).alias("b_"))
    rows = rows.join(best, [key, "cut"], "left")
    strong = F.col("b_.edge_") >= 0.5 * F.col("mean_")
    at = F.when(F.col("mean_").isNull(), F.col("even_")).when(strong, -F.col("b_.p")).otherwise(F.col("plain_"))
    return in_order(rows.select(key, "size", "cells", "cut", at.cast("long").alias("at")), key)


def _rounded(x: Column) -> Column:
    """Half up, of what isn't negative."""
    return F.floor(x + 0.5)


def in_order(cuts: DataFrame, key: str) -> DataFrame:
    """Cuts (key, size, cells, cut, at) from 0 to size, each at least one after the one before, with room for those that follow.

    at - cut may not fall, nor pass size - cells: a running maximum."""
    so_far = Window.partitionBy(key).orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    inner = F.when(F.col("cut") == 0, 0).when(F.col("cut") == F.col("cells"), F.col("size") - F.col("cells")).otherwise(F.least(F.col("at") - F.col("cut"), F.col("size") - F.col("cells")))
    return cuts.withColumn("at", (F.greatest(F.max(inner).over(so_far), F.lit(0)) + F.col("cut")).cast("long"))


def stable_cuts(cuts: DataFrame, key: str) -> DataFrame:
    """Cuts (key, size, cells, cut, at) that are too uneven give way: as they are if the widest cell has at most 1.8 of the
    narrowest one's width and none is off the mean by over 0.62 of it; six tenths of them and four of the uniform cuts
    up to 2.25 and 0.9; beyond that the uniform cuts."""
    w = Window.partitionBy(key).orderBy("cut")
    mean = F.col("size") / F.col("cells")
    wide = cuts.withColumn("next_", F.lead("at").over(w)).withColumn("width_", F.when(F.col("next_").isNotNull(), F.greatest(F.col("next_") - F.col("at"), F.lit(1)))).drop("next_")
    spread = wide.where("width_ IS NOT NULL").groupBy(key).agg((F.max("width_") / F.min("width_")).alias("ratio_"), F.max(F.abs(F.col("width_") - mean) / F.greatest(mean, F.lit(1.0))).alias("off_"))
    even = F.least(_rounded(F.col("cut") * mean), F.col("size"))
    keep, blend = (F.col("ratio_") <= 1.8) & (F.col("off_") <= 0.62), (F.col("ratio_") <= 2.25) & (F.col("off_") <= 0.9)
    rows = cuts.join(spread, key).withColumns({"even_": even, "blends_": ~keep & blend, "keeps_": keep | (F.col("cells") <= 1)})
    at = F.when(F.col("keeps_"), F.col("at")).when(F.col("blends_"), _rounded(F.col("at") * 0.6 + F.col("even_") * 0.4)).otherwise(F.col("even_")).cast("long")
    rows = rows.select(key, "size", "cells", "cut", at.alias("at"), (F.col("keeps_") | ~F.col("blends_")).alias("done_"))
    blended = in_order(rows.where("NOT done_").drop("done_"), key)
    return rows.where("done_").drop("done_").unionByName(blended)


def bilateral(pixels: DataFrame, radius: int = 2, reach: float = 2.0, tone: float = 0.08, tile: int = TILE) -> DataFrame:
    """I8: OKLab colours smoothed over the (2 radius + 1) squared around: exp(-d^2 / 2 reach^2) by place times exp(-c^2 / 2 tone^2) by colour.

    Places outside the image weigh nothing. Pictures are worked on in tiles with a halo."""

    def rule(around: Around) -> dict[str, np.ndarray]:
        lab = [around.clipped(c) for c in "LAB"]
        own = [c(0, 0)[0] for c in lab]
        total, sums = np.zeros(around.shape), [np.zeros(around.shape) for _ in lab]
        for dx, dy in around.shifts():
            near = [c(dx, dy)[0] for c in lab]
            d = [n - o for n, o in zip(near, own)]
            far = d[0] * d[0] + 1.8 * d[1] * d[1] + 1.8 * d[2] * d[2]
            w = np.exp(-(dx * dx + dy * dy) / (2 * reach * reach) - far / (2 * tone * tone)) * lab[0](dx, dy)[1]
            total, sums = total + w, [s + w * n for s, n in zip(sums, near)]
        return dict(zip("LAB", (s / np.maximum(total, 1e-300) for s in sums)))

    return over_tiles(_lab(pixels), list("LAB"), radius, rule, "L double, A double, B double", tile)


def cell_vote(pixels: DataFrame) -> DataFrame:
    """Each cell's label by votes of its pixels (image_id, x, y, cx, cy, w, label, confidence, protected).

    A vote weighs (w + 0.0001)(0.5 + confidence / 2), 2.5 times that for a protected pixel. The label of the cell's last
    protected pixel, by rows, wins if it has 0.08 of the votes. margin: the winner's share less that of the second of
    all. confident: vetoed so, or a margin of 0.35 and a share of 0.48 at least. Of equal labels the smallest wins."""
    key = ["image_id", "cx", "cy"]
    vote = (F.col("w") + 1e-4) * (0.5 + 0.5 * F.col("confidence")) * F.when(F.col("protected"), 2.5).otherwise(1.0)
    last = F.max(F.when(F.col("protected"), F.struct("y", "x", "label"))).alias("last")
    sums = pixels.groupBy(*key, "label").agg(F.sum(vote).alias("v"), last)
    w = Window.partitionBy(*key)
    rows = sums.withColumns({"all_": F.sum("v").over(w), "veto": F.max("last").over(w)["label"], "rank": F.row_number().over(w.orderBy(F.desc("v"), "label"))})
    top = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("v"))), F.lit(0.0)).alias(f"v{k}")
    cells = rows.groupBy(*key).agg(
        top(1), top(2), F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("first_"), F.max("veto").alias("veto"),
        F.max(F.when(F.col("label") == F.col("veto"), F.col("v"))).alias("vv"), F.max("all_").alias("all_"),
    )
    protected = F.coalesce(F.col("vv") >= 0.08 * F.col("all_"), F.lit(False))
    share = F.when(protected, F.col("vv")).otherwise(F.col("v1")) / F.col("all_")
    out = cells.withColumns({"protected": protected, "share": share, "margin": share - F.col("v2") / F.col("all_")})
    label = F.when(F.col("protected"), F.col("veto")).otherwise(F.col("first_"))
    return out.select(*key, label.alias("label"), "margin", "protected", (F.col("protected") | ((F.col("margin") >= 0.35) & (F.col("share") >= 0.48))).alias("confident"))


def whole_core(pixels: DataFrame, cols: int, rows: int) -> DataFrame:
    """Pixels of images cut into cols x rows cells, with cell and core: a cell begins at cx * width / cols without its fraction, and its
    core leaves out a quarter of its pixels, without the fraction, on each side."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width_"), (F.max("y") + 1).alias("height_"))

    def axis(c: str, full: str, n: int):
        # the cell whose whole-number beginning is the last at or before the place
        cell = F.floor(((F.col(c) + 1) * n - 1) / F.col(full)).cast("int")
        begin, end = F.floor(cell * F.col(full) / n), F.floor((cell + 1) * F.col(full) / n)
        edge = F.floor(F.greatest(end - begin, F.lit(1)) / 4)
        return cell, (F.col(c) >= begin + edge) & (F.col(c) < end - edge)

    (cx, mx), (cy, my) = axis("x", "width_", cols), axis("y", "height_", rows)
    kept = [c for c in pixels.columns if c not in ("cx", "cy", "core")]
    return pixels.join(size, "image_id").select(*kept, cx.alias("cx"), cy.alias("cy"), (mx & my).alias("core"))


def refine_ambiguous(votes: DataFrame, pixels: DataFrame, heats: tuple[float, ...] = (0.7, 0.4)) -> DataFrame:
    """Labels of the cells that cell_vote left ambiguous, by their pixels (with cx, cy, label, core: see whole_core) and their neighbours.

    A settled cell holds its label for sure; an ambiguous one begins with its labels' shares, core pixels counting 2 and
    others 0.5. In each round, at falling heat, its shares become proportional to exp((1.5 own + 1.2 neighbours') / heat),
    straight neighbours weighing 1 and diagonal ones 0.707. Labels that neither the cell nor a neighbour has can't win
    and take no share. Then an inner cell that isn't protected takes the label of three of its four straight neighbours,
    if it was ambiguous or its own label has less than 0.7."""
    key = ["image_id", "cx", "cy"]
    core = F.when(F.col("core"), 2.0).otherwise(0.5)
    loose = votes.where("NOT confident AND NOT protected").select(*key)
    own = pixels.groupBy(*key, "label").agg(F.sum(core).alias("p")).join(loose, key, "left_semi")
    own = own.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*key)))
    fixed = votes.where("confident OR protected").select(*key, "label", F.lit(1.0).alias("p"))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(1.0 if a == 0 or b == 0 else 0.707).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    w = Window.partitionBy(*key)
    for heat in heats:
        sent = fixed.unionByName(own).select("image_id", "label", "p", F.explode(steps).alias("o"), "cx", "cy")
        sent = sent.select("image_id", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), "label", (F.col("p") * F.col("o.w")).alias("m"))
        came = sent.join(loose, key, "left_semi").groupBy(*key, "label").agg(F.sum("m").alias("m"))
        # each neighbour's shares sum to 1, so what came sums to the neighbours' weights
        came = came.withColumn("m", F.col("m") / F.sum("m").over(w))
        both = own.join(came, [*key, "label"], "full").select(*key, "label", F.exp((1.5 * F.coalesce("p", F.lit(0.0)) + 1.2 * F.coalesce("m", F.lit(0.0))) / heat).alias("e"))
        own = both.select(*key, "label", (F.col("e") / F.sum("e").over(w)).alias("p"))
    best = own.groupBy(*key).agg(F.max_by("label", F.struct("p", -F.col("label"))).alias("better"), F.max("p").alias("p"))
    cells = votes.join(best, key, "left").select(*key, F.coalesce("better", "label").alias("label"), F.coalesce("p", F.lit(1.0)).alias("p"), "confident", "protected")
    sides = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = cells.select("image_id", F.col("label").alias("near"), F.explode(sides).alias("o"), "cx", "cy").select("image_id", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), "near")
    counted = near.groupBy(*key, "near").agg(F.count("*").alias("n")).withColumn("all_", F.sum("n").over(w)).where("n >= 3 AND all_ = 4").select(*key, "near")
    takes = F.col("near").isNotNull() & ~F.col("protected") & (~F.col("confident") | (F.col("p") < 0.7))
    return cells.join(counted, key, "left").select(*key, F.when(takes, F.col("near")).otherwise(F.col("label")).alias("label"), "confident", "protected")


def grid_slic(pixels: DataFrame, cols: int, rows: int, width: int, height: int, rounds: int = 4, tightness: float = 28.0) -> DataFrame:
    """Superpixels (image_id, x, y, cx, cy) held to a grid: pixels (image_id, x, y, lab) go to the nearest cell by colour and place.

    A pixel looks at the 3 x 3 cells around its own whose anchor is within 1.15 steps, so it is at most nine rows. A
    centre may move 0.12 of the way to its pixels' mean, which counts as at most 0.15 steps off. A centre without pixels stays."""
    sx, sy = width / cols, height / rows
    pull = tightness**2 / ((sx + sy) / 2) ** 2
    anchor = lambda c, s, size: F.least((F.col(c) + 0.5) * s, F.lit(size - 1.0))
    ax, ay = anchor("cx", sx, width), anchor("cy", sy, height)
    cells = pixels.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("cx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("cy"))
    at = cells.select("*", ax.alias("mx"), ay.alias("my")).withColumns({"x": F.floor(F.col("mx") + 0.5).cast("int"), "y": F.floor(F.col("my") + 0.5).cast("int")})
    centres = at.join(pixels.select("image_id", "x", "y", F.col("lab").alias("mean")), ["image_id", "x", "y"]).select("image_id", "cx", "cy", "mx", "my", "mean")
    nine = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asks = pixels.select("image_id", "x", "y", "lab", F.explode(nine).alias("o")).select("image_id", "x", "y", "lab", (F.floor(F.col("x") / sx) + F.col("o.dx")).cast("int").alias("cx"), (F.floor(F.col("y") / sy) + F.col("o.dy")).cast("int").alias("cy"))
    asks = asks.where((F.abs(F.col("x") - ax) <= 1.15 * sx) & (F.abs(F.col("y") - ay) <= 1.15 * sy))
    off = lambda c, a, s: F.greatest(F.lit(-0.15 * s), F.least(F.lit(0.15 * s), F.avg(c) - F.first(a)))
    for k in range(rounds):
        dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
        seen = asks.join(centres, ["image_id", "cx", "cy"]).withColumn("d", F.round(oklab_dist2("lab", "mean") + pull * (dx * dx + dy * dy), 9))
        own = seen.groupBy("image_id", "x", "y").agg(F.min(F.struct("d", "cy", "cx")).alias("b"), F.first("lab").alias("lab")).select("image_id", "x", "y", "lab", "b.cx", "b.cy")
        if k < rounds - 1:
            mean = F.struct(*[F.avg(f"lab.{c}").alias(c) for c in "LAB"]).alias("mean2")
            moved = own.withColumns({"ax": ax, "ay": ay}).groupBy("image_id", "cx", "cy").agg((F.first("ax") + 0.12 * off("x", "ax", sx)).alias("mx2"), (F.first("ay") + 0.12 * off("y", "ay", sy)).alias("my2"), mean)
            centres = centres.join(moved, ["image_id", "cx", "cy"], "left").select("image_id", "cx", "cy", F.coalesce("mx2", "mx").alias("mx"), F.coalesce("my2", "my").alias("my"), F.coalesce("mean2", "mean").alias("mean"))
    return own.drop("lab")

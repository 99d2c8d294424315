"""Grid detection over profiles and proposals: phases, peaks, lattices and the vote of several detectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import made_since, mark, release, written

from .tiles import TILE
from .windows import normalize_profile


def close(a: Column, b: Column) -> Column:
    """Sizes that differ by one, or by one in a hundred, at most."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), 0.01 * F.greatest(a, b))


def agreeing_pairs(proposals: DataFrame) -> DataFrame:
    """Pairs of an image's proposals (image_id, detector, cols, rows), each with itself too, whose sizes are close.

    Joined on the image; the rest is a residual over the few proposals that an image has."""
    other = proposals.select("image_id", F.col("detector").alias("other"), F.col("cols").alias("cols2"), F.col("rows").alias("rows2"))
    both = proposals.join(other, "image_id")
    return both.where(close(F.col("cols"), F.col("cols2")) & close(F.col("rows"), F.col("rows2")))


def grid_consensus(proposals: DataFrame, most: float = 0.35) -> DataFrame:
    """Each image's size: the middle of three or more close proposals whose aspect is near the image's (aspect: width by
    height), else the first of the first close pair, else the first proposal. consensus tells which: vote, pair or single."""
    groups = agreeing_pairs(proposals).groupBy("image_id", "aspect", "detector", "cols", "rows").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("cols2")).alias("c"), F.sort_array(F.collect_list("rows2")).alias("r"))
    middle = lambda a: F.floor((F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2).cast("int")
    near = F.abs(F.log(middle(F.col("c")) / middle(F.col("r")) / F.col("aspect"))) < most
    kind = F.when((F.col("n") >= 3) & near, 0).when(F.col("n") >= 2, 1).otherwise(2)
    ranked = groups.withColumn("kind", kind).withColumn("pick", F.struct("kind", F.when(F.col("kind") == 0, -F.col("n")).otherwise(0).alias("m"), "detector"))
    size = F.struct(F.when(F.col("kind") == 0, middle(F.col("c"))).otherwise(F.col("cols")).alias("cols"), F.when(F.col("kind") == 0, middle(F.col("r"))).otherwise(F.col("rows")).alias("rows"), "kind")
    best = ranked.withColumn("out", size).groupBy("image_id").agg(F.min_by("out", "pick").alias("o"))
    return best.select("image_id", "o.cols", "o.rows", F.element_at(F.array(F.lit("vote"), F.lit("pair"), F.lit("single")), F.col("o.kind") + 1).alias("consensus"))


def lattice_z(profile: DataFrame, key: str, pos: str, value: str, step: int = 8) -> DataFrame:
    """How far the profile stands out at multiples of step, less what stands out half a step on; in deviations."""
    at = lambda k: F.avg(F.when(F.col(pos) % step == k, F.col(value)))
    out = profile.groupBy(key).agg(at(0).alias("on"), at(step // 2).alias("off"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"))
    z = lambda c: F.when(F.col("dev") > 0, (F.col(c) - F.col("mean")) / F.col("dev")).otherwise(0.0)
    return out.select(key, (z("on") - F.greatest(z("off"), F.lit(0.0))).alias("z"))


#: Scores are compared with so many decimals: sums of doubles come in any order.
PLACES = 9


def comb_phase(profile: DataFrame, key: str, pos: str, value: str, step: float) -> DataFrame:
    """The phase at which a comb of one tooth a step meets the most edge, refined by a parabola through the best of max(8, 4 step)
    phases and its neighbours around the circle, and its strength against the mean of all phases. Of equal phases the first.

    Places count from 0 without gaps. Samples between them are interpolated: each is the weighted sum of two places, so a tooth is
    two rows of one aggregation. Profiles under three steps long, and steps under 1.5, have phase and strength 0."""
    bins = max(8, round(step * 4))
    size = profile.groupBy(key).agg(F.count("*").cast("int").alias("n_"))
    rows = profile.join(size, key)
    ahead = profile.select(key, (F.col(pos) - 1).alias(pos), F.col(value).alias("next_"))
    pairs = rows.join(ahead, [key, pos], "left").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    phase = F.col("bin") * (step / bins)
    # the tooth from pos up to pos + 1, if there is one; the last sample is the last but one place
    k = F.ceil((F.col(pos) - phase) / step - 1e-12)
    part = phase + k * step - F.col(pos)
    teeth = pairs.where((F.col("n_") >= 3 * step) & (k >= 0) & (part < 1 - 1e-12) & (F.col(pos) + part <= F.col("n_") - 2 + 1e-12))
    weight = F.greatest(part, F.lit(0.0))
    means = teeth.groupBy(key, "bin").agg(F.round(F.avg(F.col(value) * (1 - weight) + F.coalesce("next_", F.lit(0.0)) * weight), PLACES).alias("m"))
    best = means.groupBy(key).agg(F.max_by(F.struct("bin", "m"), F.struct("m", -F.col("bin"))).alias("b"), (F.sum("m") / bins).alias("mean"))
    near = best.join(means, key)
    side = lambda d: F.coalesce(F.max(F.when(F.col("bin") == F.pmod(F.col("b.bin") + d, F.lit(bins)), F.col("m"))), F.lit(0.0))
    found = near.groupBy(key).agg(F.first("b").alias("b"), F.first("mean").alias("mean"), side(-1).alias("lo"), side(1).alias("hi"))
    bend = F.col("lo") - 2 * F.col("b.m") + F.col("hi")
    shift = F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (F.col("lo") - F.col("hi")) / bend))).otherwise(0.0)
    at = (F.col("b.bin") + shift) * (step / bins)
    out = found.select(key, F.pmod(at, F.lit(float(step))).alias("phase"), (F.col("b.m") / (F.col("mean") + 1e-9)).alias("strength"))
    zero = F.lit(0.0)
    good = F.lit(step >= 1.5) & F.col("phase").isNotNull()
    return size.select(key).join(out, key, "left").select(key, F.when(good, F.col("phase")).otherwise(zero).alias("phase"), F.when(good, F.col("strength")).otherwise(zero).alias("strength"))


def summed_area(pixels: DataFrame, channels: Sequence[Column]) -> DataFrame:
    """(image_id, x, y, sums, squares): at each place the sum over the rectangle from the corner to it of each channel, and of all
    channels' squares. Pictures are whole rectangles from (0, 0). Two running sums, one along each axis: no pixel is copied."""
    along, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    names = [f"c{k}_" for k in range(len(channels))] + ["q_"]
    rows = pixels.select("image_id", "x", "y", *[c.cast("double").alias(n) for c, n in zip(channels, names)])
    rows = rows.withColumn("q_", sum((F.col(n) * F.col(n) for n in names[:-1]), F.lit(0.0)))
    for w in (along, down):
        rows = rows.select("image_id", "x", "y", *[F.sum(n).over(w).alias(n) for n in names])
    return rows.select("image_id", "x", "y", F.array(*names[:-1]).alias("sums"), F.col("q_").alias("squares"))


def rectangles(area: DataFrame, cells: DataFrame, keys: Sequence[str], channels: int) -> DataFrame:
    """cells (keys, image_id among them, and x0, x1, y0, y1, the ends left out) with area, and variance: the mean square less the squared
    means of the channels. Each rectangle asks for its four corners in a summed-area table: one equi-join."""
    corner = lambda x, y, sign: F.struct((F.col(x) - 1).alias("x"), (F.col(y) - 1).alias("y"), F.lit(sign).alias("sign"))
    four = F.array(corner("x1", "y1", 1), corner("x0", "y1", -1), corner("x1", "y0", -1), corner("x0", "y0", 1))
    box = ["x0", "x1", "y0", "y1"]
    asks = cells.select(*keys, *box, F.explode(four).alias("k")).where("k.x >= 0 AND k.y >= 0").select(*keys, *box, "k.x", "k.y", "k.sign")
    met = asks.join(area, ["image_id", "x", "y"]).groupBy(*keys, *box).agg(*[F.sum(F.col("sign") * F.col("sums")[c]).alias(f"s{c}_") for c in range(channels)], F.sum(F.col("sign") * F.col("squares")).alias("q_"))
    size = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1)).cast("double")
    mean2 = sum((F.pow(F.col(f"s{c}_") / size, F.lit(2.0)) for c in range(channels)), F.lit(0.0))
    return met.select(*keys, *box, size.alias("area"), (F.col("q_") / size - mean2).alias("variance"))


def phase_spans(sizes: DataFrame, extent: str, phases: Sequence[float], step: float, number: str, low: str, high: str) -> DataFrame:
    """(image_id, number, low, high): for each phase the stretches between the lattice's lines, rounded to whole places (halves to even) and
    held inside the picture; the first one begins at 0."""
    each = sizes.select("image_id", F.col(extent).alias("e_"), F.posexplode(F.array(*[F.lit(float(p)) for p in phases])).alias(number, "p_"))
    n = F.greatest(F.ceil((F.col("e_") + step - F.col("p_")) / step), F.lit(1)).cast("int")
    line = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.greatest(F.bround(F.col("p_") + i * step), F.lit(0.0)), F.col("e_").cast("double")).cast("int"))
    cuts = F.array_distinct(F.concat(F.array(F.lit(0)), line))
    each = each.select("image_id", number, cuts.alias("c_"))
    return each.select("image_id", number, F.explode(F.arrays_zip(F.slice("c_", 1, F.size("c_") - 1).alias("a"), F.slice("c_", 2, F.size("c_") - 1).alias("b"))).alias("s")).select("image_id", number, F.col("s.a").alias(low), F.col("s.b").alias(high))


def line_before(place: Column, phase: float, step: float) -> Column:
    """The last line at or before a place of the lattice whose lines are rounded to whole places (halves to even), the first one 0."""
    k = F.floor((place - phase) / step)
    line = lambda n: F.rint(phase + n * step)
    return F.greatest(F.when(line(k + 1) <= place, line(k + 1)).otherwise(line(k)), F.lit(0.0)).cast("long")


def phase_variances(pixels: DataFrame, step_x: float, step_y: float, xs: Sequence[float], ys: Sequence[float], band: int = TILE) -> DataFrame:
    """(image_id, iy, ix, variance) for each phase on either axis: A20 of its cells, that is red, green and blue together, weighed by area.

    Pixels are shuffled once, in bands of rows. There they are summed along the rows for each phase across, and these sums down the
    band for each phase down; only cells that a band cuts are shuffled again."""
    sums = ["n_", "r_", "g_", "b_", "q_"]
    whole = [F.col(c).cast("double") for c in "rgb"]
    rows = pixels.select("image_id", F.floor(F.col("y") / band).alias("band_"), "x", "y", F.lit(1.0).alias("n_"), *[c.alias(f"{n}_") for c, n in zip(whole, "rgb")]).repartition("image_id", "band_")
    rows = rows.withColumn("q_", F.col("r_") * F.col("r_") + F.col("g_") * F.col("g_") + F.col("b_") * F.col("b_"))
    lines = lambda c, number, phases, step: F.explode(F.array(*[F.struct(F.lit(k).alias(number), line_before(F.col(c), float(p), float(step)).alias(f"{c}0")) for k, p in enumerate(phases)])).alias("o_")
    key = ["image_id", "band_"]
    add = [F.sum(c).alias(c) for c in sums]
    across = rows.select(*key, "y", *sums, lines("x", "ix", xs, step_x)).groupBy(*key, "y", "o_.ix", "o_.x0").agg(*add)
    cells = across.select(*key, "y", "ix", "x0", *sums, lines("y", "iy", ys, step_y)).groupBy(*key, "o_.iy", "ix", "o_.y0", "x0").agg(*add, F.max("y").alias("low_"))
    squares = F.col("q_") / F.col("n_") - sum((F.pow(F.col(f"{c}_") / F.col("n_"), F.lit(2.0)) for c in "rgb"), F.lit(0.0))
    # a cell that ends with its band may go on in the next one, one that begins before its band begins there
    cut = (F.col("y0") < F.col("band_") * band) | (F.col("low_") == F.col("band_") * band + band - 1)
    place = lambda c: F.when(cut, F.col(c)).otherwise(-1).alias(c)
    parts = cells.select("image_id", "iy", "ix", place("y0"), place("x0"), *sums, F.when(~cut, squares * F.col("n_")).alias("s_"))
    met = parts.groupBy("image_id", "iy", "ix", "y0", "x0").agg(*add, F.sum("s_").alias("s_"))
    return met.groupBy("image_id", "iy", "ix").agg((F.sum(F.coalesce("s_", squares * F.col("n_"))) / F.sum("n_")).alias("variance"))


def grid_variance(pixels: DataFrame, step_x: float, step_y: float | None = None, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(image_id, variance): the mean variance of colours inside the cells of a grid, weighed by area."""
    return phase_variances(pixels, step_x, step_y or step_x, [offset[0]], [offset[1]]).select("image_id", "variance")


def best_phase(pixels: DataFrame, step_x: float, step_y: float | None = None, tries: int = 5) -> DataFrame:
    """Of tries x tries offsets of a grid, which may have other steps across than down, the one with the least variance inside its cells;
    of equal ones the first down, then across."""
    step_y = step_y or step_x
    xs, ys = ([k * (step / tries) for k in range(tries)] for step in (step_x, step_y))
    found = phase_variances(pixels, step_x, step_y, xs, ys).withColumn("near_", F.round(F.round("variance", PLACES), 6))
    best = found.groupBy("image_id").agg(F.min(F.struct("near_", "iy", "ix")).alias("b"))
    offset = lambda values, c: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(c) + 1)
    return best.select("image_id", offset(xs, "b.ix").alias("ox"), offset(ys, "b.iy").alias("oy"), F.col("b.near_").alias("variance"))


def peak_places(profile: DataFrame, key: Sequence[str], pos: str, value: str, height: float) -> DataFrame:
    """(key, peak, height): the local maxima of each profile from `height` up, a plateau at its middle; places are whole numbers."""
    line = Window.partitionBy(*key).orderBy(pos)
    rows = profile.select(*key, F.col(pos).cast("long").alias("p_"), F.col(value).cast("double").alias("v_"), F.coalesce((F.col(value) != F.lag(value).over(line)).cast("int"), F.lit(1)).alias("new_"))
    rows = rows.withColumn("run_", F.sum("new_").over(Window.partitionBy(*key).orderBy("p_")))
    flat = rows.groupBy(*key, "run_").agg(F.min("p_").alias("a_"), F.max("p_").alias("b_"), F.first("v_").alias("v_"))
    w = Window.partitionBy(*key).orderBy("run_")
    flat = flat.withColumns({"before_": F.lag("v_").over(w), "after_": F.lead("v_").over(w)})
    top = (F.col("before_") < F.col("v_")) & (F.col("after_") < F.col("v_")) & (F.col("v_") >= height)
    return flat.where(top).select(*key, F.floor((F.col("a_") + F.col("b_")) / 2).alias("peak"), F.col("v_").alias("height"))


#: Units of a distance of up to 2**15 places, and how many of them two peaks nearer than it are apart at most.
UNIT = 1 << 32
NEAR = UNIT - (1 << 16)


def apart(peaks: DataFrame, key: Sequence[str], distance: str = "distance") -> DataFrame:
    """(key, peak, height): the peaks that stay when the highest one, of equals the last, drives out all that are nearer to it than `distance`
    (a column, alike for a key), then the next that is left, and so on.

    By rounds: an undecided peak that is the highest of the undecided ones around it stays, and its neighbours go. These are windows over
    places, so no task walks a profile peak by peak, and rounds are as many as the longest chain of falling peaks that
    drive each other out."""
    spark = peaks.sparkSession
    # a window's bounds are constants, so places are counted in units of the distance, of which UNIT make one
    at = F.round(F.col("peak") * F.lit(float(UNIT)) / F.col(distance)).cast("long")
    state = written(peaks.select(*key, "peak", "height", at.alias("at_"), F.lit(0).alias("decided")), "peaks")
    around = Window.partitionBy(*key).orderBy("at_").rangeBetween(-NEAR, NEAR)
    while not state.where("decided = 0").isEmpty():
        begun = mark() - 1
        rank = F.struct("height", "peak")
        open_ = state.withColumn("best_", F.max(F.when(F.col("decided") == 0, rank)).over(around) == rank)
        open_ = open_.withColumn("stays_", ((F.col("decided") == 0) & F.col("best_")).cast("int")).withColumn("near_", F.max("stays_").over(around))
        decided = F.when(F.col("decided") != 0, F.col("decided")).when(F.col("stays_") == 1, 1).when(F.col("near_") == 1, -1).otherwise(0)
        state = written(open_.select(*key, "peak", "height", "at_", decided.alias("decided")), "peaks")
        release(spark, made_since(begun)[:1])
    return state.where("decided = 1").select(*key, "peak", "height")


def find_peaks(profile: DataFrame, key: str, pos: str, value: str, height: float, distance: float) -> DataFrame:
    """Local maxima of each profile, plateaus at their middle, at least `height`; of two nearer than `distance`, rounded up, the higher
    stays, of equal ones the later."""
    found = peak_places(profile, [key], pos, value, height)
    if distance <= 1:
        return found
    return apart(found.withColumn("distance", F.lit(float(math.ceil(distance)))), [key])


def rayleigh(profile: DataFrame, key: str, pos: str, value: str, steps: Sequence[float]) -> DataFrame:
    """How coherent a profile's peaks are at each step: R sqrt(2 n_eff), by heights, times the share of slots that have a peak within
    0.35 steps of the lattice at the common phase.

    The profile is normalised (W19); peaks are those of at least 0.15, two fifths of a step apart, without the two ends. Steps
    under 2 or over a quarter of the profile, and fewer than five peaks, give 0. Places count from 0 without gaps."""
    norm = normalize_profile(profile, [key], pos, value)
    size = profile.groupBy(key).agg((F.count("*") - 1).alias("n_"))
    asked = size.select(key, "n_", F.explode(F.array(*[F.lit(float(s)) for s in steps])).alias("step"))
    good = asked.where((F.col("step") >= 2) & (F.col("step") <= F.col("n_") / 4))
    inner = norm.join(size, key).where((F.col(pos) >= 1) & (F.col(pos) < F.col("n_")))
    peaks = peak_places(inner, [key], pos, "norm", 0.15).join(good.select(key, "step"), key)
    peaks = peaks.withColumn("distance", F.greatest(F.floor(F.col("step") * 0.4), F.lit(1)).cast("double"))
    kept = written(apart(peaks, [key, "step"]), "rayleigh-peaks")
    angle = F.lit(2 * math.pi) * F.col("peak") / F.col("step")
    h = F.col("height")
    sums = kept.groupBy(key, "step").agg(F.sum(h * F.cos(angle)).alias("re"), F.sum(h * F.sin(angle)).alias("im"), F.sum(h).alias("h"), F.sum(h * h).alias("hh"), F.count("*").alias("found")).where("found >= 5")
    raw = F.atan2("im", "re") / (2 * math.pi) * F.col("step")
    sums = sums.withColumn("phase", raw - F.floor(raw / F.col("step")) * F.col("step"))
    met = kept.join(sums.select(key, "step", "phase"), [key, "step"]).withColumn("slot", F.bround((F.col("peak") - F.col("phase")) / F.col("step")))
    slots = met.where(F.abs(F.col("peak") - F.col("phase") - F.col("slot") * F.col("step")) < 0.35 * F.col("step")).groupBy(key, "step").agg(F.count_distinct("slot").alias("slots"))
    room = F.greatest(F.floor(F.col("n_") / F.col("step")) - 1, F.lit(1))
    share = F.least(F.coalesce("slots", F.lit(0)) / room, F.lit(1.0))
    score = F.sqrt(2 * F.col("h") * F.col("h") / F.col("hh")) * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("h") * share
    return asked.join(sums, [key, "step"], "left").join(slots, [key, "step"], "left").select(key, "step", F.coalesce(score, F.lit(0.0)).alias("score"))


def pick_step(scores: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """The largest step whose score is within share of the best."""
    best = scores.groupBy(key).agg(F.max("score").alias("top"))
    return scores.join(best, key).where(F.col("score") >= share * F.col("top")).groupBy(key).agg(F.max("step").alias("step"))


#: Places at which contrast looks, at most; more are thinned out evenly.
LOOKS = 2600


def phase_contrast(pixels: DataFrame, step: float, tries: int = 3) -> DataFrame:
    """How much the phase of a grid matters: (worst - best) / (best + variance / 20), of the mean variance of the cells around the active
    places, over tries x tries phases. Colours count as far as they are opaque, with opacity as a fourth channel.

    Active are blocks of 8 x 8 whose variance is over a fiftieth of the picture's; with fewer than eight of these all blocks are
    looked at, and their own mean variance is the formula's, or the picture's where none is active. Steps under 1.5 or over a
    third of a side, and even pictures, give 0. A picture under 8 places on a side is one block of its shorter side."""
    share = F.col("a") / 255.0
    area = written(summed_area(pixels, [*(F.col(c) * share for c in "rgb"), F.col("a")]), "contrast-sums")
    sizes = written(pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w_"), (F.max("y") + 1).alias("h_")), "contrast-sizes")
    full = rectangles(area, sizes.select("image_id", F.lit(0).alias("x0"), F.col("w_").alias("x1"), F.lit(0).alias("y0"), F.col("h_").alias("y1")), ["image_id"], 4).select("image_id", F.col("variance").alias("all_"))
    block = F.when(F.least("w_", "h_") < 8, F.least("w_", "h_")).otherwise(8)
    places = sizes.withColumn("b_", block).select("image_id", "b_", F.explode(F.sequence(F.lit(0), F.floor(F.when(F.col("b_") < 8, 0).otherwise(F.col("w_") / 8 - 1)).cast("int"))).alias("i"), "h_")
    places = places.select("image_id", "b_", "i", F.explode(F.sequence(F.lit(0), F.floor(F.when(F.col("b_") < 8, 0).otherwise(F.col("h_") / 8 - 1)).cast("int"))).alias("j"))
    blocks = places.select("image_id", (F.col("i") * 8).alias("x0"), (F.col("i") * 8 + F.col("b_")).alias("x1"), (F.col("j") * 8).alias("y0"), (F.col("j") * 8 + F.col("b_")).alias("y1"))
    seen = rectangles(area, blocks, ["image_id"], 4).join(full, "image_id").withColumn("active", F.col("variance") > F.greatest(0.02 * F.col("all_"), F.lit(1e-6)))
    of_image = Window.partitionBy("image_id")
    seen = seen.withColumns({"n_": F.count_if("active").over(of_image), "own_": F.avg(F.when(F.col("active"), F.col("variance"))).over(of_image)})
    looks = seen.where(F.col("active") | (F.col("n_") < 8)).withColumns({"k_": F.row_number().over(of_image.orderBy("y0", "x0")) - 1, "m_": F.count("*").over(of_image)})
    # look i is taken if some l in 0 .. LOOKS - 1 has floor(l (m - 1) / (LOOKS - 1)) = i
    first = F.ceil(F.col("k_") * (LOOKS - 1) / F.greatest(F.col("m_") - 1, F.lit(1)))
    looks = looks.where((F.col("m_") <= LOOKS) | ((first <= LOOKS - 1) & (F.floor(first * (F.col("m_") - 1) / (LOOKS - 1)) == F.col("k_"))))
    looks = looks.select("image_id", "all_", F.coalesce("own_", "all_").alias("own_"), "k_", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py")).join(sizes, "image_id")
    phases = [k * (step / tries) for k in range(tries)]
    grid = F.array(*[F.struct(F.lit(float(x)).alias("ox"), F.lit(float(y)).alias("oy")) for y in phases for x in phases])

    def edges(p: str, o: str, size: str) -> tuple[Column, Column]:
        begin = F.col(o) + F.floor((F.col(p) - F.col(o)) / step) * step
        low = F.least(F.greatest(F.bround(begin), F.lit(0.0)), F.col(size) - 1.0).cast("int")
        return low, F.least(F.greatest(F.bround(begin + step), low + 1.0), F.col(size).cast("double")).cast("int")

    asks = looks.where((F.lit(step) >= 1.5) & (F.lit(float(step)) <= F.col("w_") / 3) & (F.lit(float(step)) <= F.col("h_") / 3) & (F.col("all_") > 1e-9)).select("*", F.posexplode(grid).alias("o_", "g")).select("*", "g.ox", "g.oy")
    (x0, x1), (y0, y1) = edges("px", "ox", "w_"), edges("py", "oy", "h_")
    cells = asks.select("image_id", "o_", "k_", "own_", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    found = rectangles(area, cells, ["image_id", "o_", "k_", "own_"], 4)
    means = found.groupBy("image_id", "own_", "o_").agg(F.avg(F.greatest("variance", F.lit(0.0))).alias("v"))
    best, worst = F.min("v"), F.max("v")
    out = means.groupBy("image_id").agg(((worst - best) / (best + 0.05 * F.first("own_"))).alias("contrast"))
    return sizes.select("image_id").join(out, "image_id", "left").select("image_id", F.coalesce("contrast", F.lit(0.0)).alias("contrast"))


def pick_peak_step(scores: DataFrame, runs: DataFrame, key: str, value: str, share: float = 0.7, support: float = 0.04, least: int = 50) -> DataFrame:
    """Of the steps whose comb score is a local maximum the largest that has `share` of the best one's score and enough
    support, else the best. Support: that `support` of the runs (key, value) lie within max(0.6, 0.18 step) of it. With fewer than
    `least` runs, or without a positive maximum, there is no step.

    Steps are a short list for each key, so runs meet them by the key."""
    w = Window.partitionBy(key).orderBy("step")
    before, after = F.lag("score").over(w), F.lead("score").over(w)
    peaks = scores.withColumn("peak_", (F.col("score") > before) & (F.col("score") >= after)).where("peak_").drop("peak_")
    top = peaks.groupBy(key).agg(F.max("score").alias("top_"), F.max_by("step", F.struct("score", -F.col("step"))).alias("best_")).where("top_ > 0")
    counts = runs.groupBy(key, F.col(value).alias("run_")).agg(F.count("*").alias("n_"))
    total = counts.groupBy(key).agg(F.sum("n_").alias("total_")).where(F.col("total_") >= least)
    top = top.join(total.select(key), key, "left_semi")
    tied = peaks.join(top, key).where(F.col("score") >= share * F.col("top_"))
    near = F.abs(F.col("run_") - F.col("step")) < F.greatest(F.lit(0.6), 0.18 * F.col("step"))
    held = tied.join(counts, key).groupBy(key, "step").agg(F.sum(F.when(near, F.col("n_")).otherwise(0)).alias("near_")).join(total, key).where(F.col("near_") >= support * F.col("total_"))
    largest = held.groupBy(key).agg(F.max("step").alias("step_"))
    return top.join(largest, key, "left").select(key, F.coalesce("step_", "best_").alias("step"))


def band_profiles(lines: DataFrame, key: str, line: str, pos: str, value: str, band: int) -> DataFrame:
    """Sums of each `band` neighbouring lines as profiles (key, band, pos, value); lines that fill no band are left out, but
    for an image of fewer lines than that, which is one band."""
    n = lines.groupBy(key).agg((F.max(line) + 1).alias("lines_"))
    rows = lines.join(n, key).withColumn("band", F.when(F.col("lines_") < band, 0).otherwise(F.floor(F.col(line) / band)).cast("int"))
    return rows.where((F.col("lines_") < band) | (F.col("band") < F.floor(F.col("lines_") / band))).groupBy(key, "band", pos).agg(F.sum(value).alias(value))


def acf_comb(acf: DataFrame, key: str, steps: Sequence[float], most: int = 6, fade: float = 3.0, plain: bool = False) -> DataFrame:
    """For each step the autocorrelation at its multiples, less (unless plain) that half a step to both sides, faded by
    exp(-(k - 1) / fade). Lags count from 0; samples between them are interpolated. A step with fewer than two multiples
    inside scores -1, or 0 if plain and it has none."""
    table = acf.groupBy(key).agg(F.count("*").alias("n_"), F.map_from_entries(F.collect_list(F.struct(F.col("lag").cast("long").alias("lag"), "acf"))).alias("acf_"))
    asks = table.select(key, "n_", "acf_", F.explode(F.array(*[F.lit(float(s)) for s in steps])).alias("step"))
    asks = asks.withColumn("kcap", F.least(F.greatest(F.floor((F.col("n_") - 2) / F.col("step")), F.lit(0)), F.lit(most)).cast("int"))
    parts = [(0.0, 1.0)] if plain else [(0.0, 1.0), (-0.5, -0.5), (0.5, -0.5)]
    weight = lambda k: F.exp(-(k - 1) / fade)
    read = lambda lag: F.coalesce(F.element_at("acf_", F.least(lag, F.col("n_") - 1)), F.lit(0.0))

    def sample(at: Column) -> Column:
        low = F.floor(at)
        f = F.least(F.greatest(at - F.least(low, F.col("n_") - 1), F.lit(0.0)), F.lit(1.0))
        return (1 - f) * read(low) + f * read(low + 1)

    tooth = lambda k: sum((c * sample((k + o) * F.col("step")) for o, c in parts), F.lit(0.0))
    ks = F.sequence(F.lit(1), F.col("kcap"))
    mean = F.aggregate(ks, F.lit(0.0), lambda s, k: s + weight(k) * tooth(k)) / F.aggregate(ks, F.lit(0.0), lambda s, k: s + weight(k))
    return asks.select(key, "step", F.when(F.col("kcap") >= (1 if plain else 2), mean).otherwise(0.0 if plain else -1.0).alias("score"))


def tile_coherence(peaks: DataFrame, key: str, tile: str, pos: str, height: str, extent: str, steps: Sequence[float]) -> DataFrame:
    """How coherent peaks are at each step, over the tiles of an image (peaks: key, tile, pos, height, extent of the tile).

    For a tile: R sqrt(2 n_eff), by heights, times the share of its slots that have a peak within 0.35 steps of the lattice at
    the common phase, less 1. Tiles of fewer than four peaks, or under three steps long, don't count. Two tiles or more
    combine to the sum of their scores by the square root of their number; fewer give 0."""
    rows = peaks.select(key, tile, pos, height, extent, F.explode(F.array(*[F.lit(float(s)) for s in steps])).alias("step"))
    angle = F.lit(2 * math.pi) * F.col(pos) / F.col("step")
    sums = rows.groupBy(key, tile, "step").agg(
        F.sum(F.col(height) * F.cos(angle)).alias("re"), F.sum(F.col(height) * F.sin(angle)).alias("im"), F.sum(height).alias("h"), F.sum(F.col(height) * F.col(height)).alias("hh"), F.count("*").alias("n"), F.max(extent).alias("extent_")
    ).where((F.col("n") >= 4) & (F.col("step") <= F.col("extent_") / 3) & (F.col("step") >= 2))
    raw = F.atan2("im", "re") / (2 * math.pi) * F.col("step")
    sums = sums.withColumn("phase", raw - F.floor(raw / F.col("step")) * F.col("step"))
    met = rows.join(sums.select(key, tile, "step", "phase"), [key, tile, "step"]).withColumn("slot", F.bround((F.col(pos) - F.col("phase")) / F.col("step")))
    slots = met.where(F.abs(F.col(pos) - F.col("phase") - F.col("slot") * F.col("step")) < 0.35 * F.col("step")).groupBy(key, tile, "step").agg(F.count_distinct("slot").alias("slots"))
    z = F.sqrt(2 * F.col("h") * F.col("h") / (F.col("hh") + 1e-9)) * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("h") + 1e-9)
    share = F.least(F.coalesce("slots", F.lit(0)) / F.greatest(F.floor(F.col("extent_") / F.col("step")), F.lit(1)), F.lit(1.0))
    scored = sums.join(slots, [key, tile, "step"], "left").select(key, "step", (z * share - 1).alias("z"))
    return scored.groupBy(key, "step").agg(F.when(F.count("*") >= 2, F.sum("z") / F.sqrt(F.count("*"))).otherwise(0.0).alias("score"))

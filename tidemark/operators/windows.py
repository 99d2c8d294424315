"""Window operators over ordered events. Spark sorts a key's history and can spill it; where a few keys hold nearly all
rows (nodes), histories are cut into slices of time that are worked on apart and then put together."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each key's last row in the given order; an aggregation, so a hot key meets partial results only."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return events.groupBy(key).agg(last).select(key, *[F.col("last")[c].alias(c) for c in rest])


def change_feed(events: DataFrame, key: str, order: Sequence[str], mode: str = "changes", fields: Sequence[str] = ("status", "percent")) -> DataFrame:
    """All updates, or those that differ from the one before; ends with the first completed or error row."""
    w = Window.partitionBy(key).orderBy(*order)
    ends = F.col("status").isin("completed", "error").cast("int")
    out = events.withColumn("ended_", F.coalesce(F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("ended_ = 0").drop("ended_")
    if mode == "all":
        return out
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.lag(f).over(w))
    return out.withColumn("same_", same & (F.row_number().over(w) > 1)).where("NOT same_").drop("same_")


def apply_updates(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The state after each update: fields last set, an error over all, and nothing after the first terminal status."""
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))
    rows = events.withColumn("set_", status)
    over = F.max(F.col("set_").isin("completed", "error", "cancelled").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("over_", F.coalesce(over, F.lit(0))).where("over_ = 0")
    return rows.select(key, *order, F.last("set_", True).over(so_far).alias("status"), F.last("percent", True).over(so_far).alias("percent"))


#: A slice of time, in seconds.
SLICE = 3600


def _slice(at, seconds: int = SLICE):
    """The slice of a time in microseconds. It follows from the row alone, so every pass over the rows cuts alike."""
    return F.floor(at / F.lit(seconds * 1_000_000)).alias("slice_")


def slice_seconds(rows: DataFrame, keys: Sequence[str], at, most: int = 1_000_000) -> int:
    """How long slices may be so that about `most` rows of a key fall into one: the busiest hour of any key is counted."""
    busiest = rows.groupBy(*keys, _slice(at)).count().agg(F.max("count")).first()[0] or 0
    return max(1, SLICE // max(1, math.ceil(busiest / most)))


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value, name: str, at=None, seconds: int = SLICE) -> DataFrame:
    """rows with the sum of value from each key's first row on. order[0] is a timestamp, or `at` gives its microseconds.

    Each slice of a key is summed by itself; what came before a slice is a running sum over one row for each slice."""
    cut = rows.withColumn("slice_", _slice(_micros(order[0]) if at is None else at, seconds)).withColumn("v_", value)
    own = Window.partitionBy(*keys, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "slice_").agg(F.sum("v_").alias("t_"))
    earlier = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "slice_", F.coalesce(F.sum("t_").over(earlier), F.lit(0)).alias("before_"))
    return cut.withColumn("own_", F.sum("v_").over(own)).join(before, [*keys, "slice_"]).withColumn(name, F.col("own_") + F.col("before_")).select(*rows.columns, name)


def running_max(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value, name: str, at=None, seconds: int = SLICE) -> DataFrame:
    """rows with the largest value from each key's first row on, nulls left out; by slices, as running_sum."""
    cut = rows.withColumn("slice_", _slice(_micros(order[0]) if at is None else at, seconds)).withColumn("v_", value)
    own = Window.partitionBy(*keys, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "slice_").agg(F.max("v_").alias("t_")).select(*keys, "slice_", F.max("t_").over(earlier).alias("before_"))
    return cut.withColumn("own_", F.max("v_").over(own)).join(before, [*keys, "slice_"]).withColumn(name, F.greatest("own_", "before_")).select(*rows.columns, name)


def ewma_latency(requests: DataFrame, node: str = "node", order: Sequence[str] = ("ts", "event_id"), value: str = "duration_ms", alpha: float = 0.2, start: float = 15.0, failed=None, penalty: float = 500.0, block: int = SLICE) -> DataFrame:
    """Each node's last moving average, x = (1 - alpha) x + alpha v from `start`. Where the column `failed` is true,
    v is the latency and `penalty`, as in the converter pool.

    The step is affine, so each slice of a node's history, `block` seconds long, folds to (decay, offset), and slices are
    composed in order. No task holds or sorts a node's whole history."""
    keep = F.lit(1.0 - alpha)
    v = F.col(value) if failed is None else F.col(value) + F.when(failed, penalty).otherwise(0.0)
    rows = requests.select(node, *order, v.alias("v"), _slice(_micros(order[0]), block))
    backwards = Window.partitionBy(node, "slice_").orderBy(*[F.col(c).desc() for c in order])
    folded = rows.withColumn("left", F.row_number().over(backwards) - 1).groupBy(node, "slice_").agg(F.sum(alpha * F.col("v") * F.pow(keep, F.col("left"))).alias("offset"), F.count("*").alias("n"))
    later = Window.partitionBy(node).orderBy(F.col("slice_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = folded.withColumn("after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return after.groupBy(node).agg((F.sum(F.col("offset") * F.pow(keep, F.col("after"))) + start * F.pow(keep, F.sum("n"))).alias("ewma"))


def running_ewma(requests: DataFrame, node: str, order: Sequence[str], value, at, alpha: float = 0.2, start: float = 15.0) -> DataFrame:
    """requests with the moving average after each row, as ewma. at: the microseconds of order[0].

    Rows are numbered by slices, and blocks of rows in a row are averaged apart. A block is so long that what came two
    blocks before weighs less than 1e-18, so a block needs the fold of the one before it only."""
    keep = 1.0 - alpha
    block = max(64, math.ceil(math.log(1e-18) / math.log(keep)))
    rows = running_sum(requests.withColumn("v_in", value), [node], order, F.lit(1), "k_", at)
    rows = rows.withColumns({"block_": F.floor((F.col("k_") - 1) / block), "i_": (F.col("k_") - 1) % block})
    w = Window.partitionBy(node, "block_").orderBy("i_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own_", F.sum(alpha * F.col("v_in") * F.pow(F.lit(keep), -F.col("i_"))).over(w) * F.pow(F.lit(keep), F.col("i_")))
    ends = rows.groupBy(node, "block_").agg(F.max_by("own_", "i_").alias("end_"))
    before = ends.select(node, (F.col("block_") + 1).alias("block_"), "end_")
    base = F.when(F.col("block_") == 0, start).when(F.col("block_") == 1, F.col("end_") + start * keep**block).otherwise(F.col("end_"))
    return rows.join(before, [node, "block_"], "left").withColumn("ewma", F.col("own_") + base * F.pow(F.lit(keep), F.col("i_") + 1)).select(*requests.columns, "ewma")


def failures_in_row(requests: DataFrame, node: str, order: Sequence[str], failed, at=None, seconds: int = SLICE) -> DataFrame:
    """requests with failed (0 or 1) and in_row: how many failures in a row end with each row; 0 after a success.

    Rows are counted since the last success of their slice. A slice without one adds to what the slices before end with, which
    follows from a row a slice: its rows, if all failed, or the failures at its end."""
    rows = requests.withColumns({"failed": failed.cast("int"), "slice_": _slice(_micros(order[0]) if at is None else at, seconds)})
    own = Window.partitionBy(node, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k_", F.row_number().over(Window.partitionBy(node, "slice_").orderBy(*order))).withColumn("ok_", F.max(F.when(F.col("failed") == 0, F.col("k_"))).over(own))
    ends = rows.groupBy(node, "slice_").agg((F.max("k_") - F.coalesce(F.max("ok_"), F.lit(0))).alias("end_"), F.max("ok_").isNotNull().cast("int").alias("broken_"))
    so_far = Window.partitionBy(node).orderBy("slice_")
    ends = ends.withColumn("run_", F.sum("broken_").over(so_far)).withColumn("total_", F.sum("end_").over(Window.partitionBy(node, "run_").orderBy("slice_")))
    before = ends.select(node, "slice_", F.coalesce(F.lag("total_").over(so_far), F.lit(0)).alias("before_"))
    in_row = F.col("k_") - F.coalesce("ok_", F.lit(0)) + F.when(F.col("ok_").isNull(), F.col("before_")).otherwise(0)
    return rows.join(before, [node, "slice_"]).withColumn("in_row", in_row).select(*requests.columns, "failed", "in_row")


def load_score(requests: DataFrame, averages: DataFrame, node: str = "node", value: str = "duration_ms") -> DataFrame:
    """At each request's start, the node's open requests, and (open + 1) times the node's average.

    Starts count +1 and ends -1; a running sum over both gives what is open. At one instant ends come first."""
    start = _micros("ts")
    both = F.array(F.struct(start.alias("at"), F.lit(1).alias("step")), F.struct((start + (F.col(value) * 1000).cast("long")).alias("at"), F.lit(-1).alias("step")))
    turns = requests.select(node, "event_id", F.explode(both).alias("t")).select(node, "event_id", "t.at", "t.step")
    running = running_sum(turns, [node], ["at", "step", "event_id"], F.col("step"), "active", F.col("at"))
    return running.where("step = 1").join(averages, node).select(node, "event_id", "active", ((F.col("active") + 1) * F.col("ewma")).alias("score"))


def counter_rates(samples: DataFrame, keys: Sequence[str], ts: str, counters: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Each counter's growth a second since the sample before; a counter that fell grew by 0. Samples of one instant go by `then`;
    between them growth is infinitely fast, and none is no number."""
    w = Window.partitionBy(*keys).orderBy(ts, *then)
    took = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))) / 1e6
    grew = lambda c: F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0))
    at_once = lambda c: F.when(grew(c) > 0, F.lit(math.inf)).otherwise(F.lit(math.nan))
    rates = [F.when(took == 0, at_once(c)).otherwise(grew(c) / F.nullif(took, F.lit(0.0))).alias(f"{c}_rate") for c in counters]
    return samples.select(*keys, ts, *rates)


def busy_percent(samples: DataFrame, keys: Sequence[str], ts: str, then: Sequence[str] = ()) -> DataFrame:
    """Processor use from idle and total counters, 0 to 100. Samples of one instant go by `then`."""
    w = Window.partitionBy(*keys).orderBy(ts, *then)
    grew = lambda c: F.col(c) - F.lag(c).over(w)
    share = F.when(grew("total") > 0, 100.0 * (1 - grew("idle") / grew("total")))
    return samples.select(*keys, ts, F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))).alias("busy"))


def group_lines(lines: DataFrame, key: str, pos: str, is_header) -> DataFrame:
    """Segment counts the headers up to each line; lines before the first are in segment 0."""
    w = Window.partitionBy(key).orderBy(pos)
    return lines.withColumn("segment", F.sum(is_header.cast("int")).over(w))


def derivatives(grid: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Absolute first and second differences along each line."""
    w = Window.partitionBy(*keys).orderBy(pos)
    v = F.col(value)
    return grid.select(*keys, pos, F.abs(v - F.lag(v).over(w)).alias("d1"), F.abs(F.lead(v).over(w) - 2 * v + F.lag(v).over(w)).alias("d2"))


def lag_diffs(bounds: DataFrame, keys: Sequence[str], pos: str, lags: int = 4, low: int = 2, high: int = 64) -> DataFrame:
    """Distances from each boundary to the next few, those within bounds."""
    w = Window.partitionBy(*keys).orderBy(pos)
    ahead = F.array(*[F.lead(pos, k).over(w) - F.col(pos) for k in range(1, lags + 1)])
    return bounds.withColumn("ahead_", ahead).select(*keys, pos, F.posexplode_outer("ahead_").alias("k", "diff")).where(F.col("diff").between(low, high)).select(*keys, pos, (F.col("k") + 1).alias("lag"), "diff")


def box_mean(profile: DataFrame, keys: Sequence[str], pos: str, value: str, radius: int = 3) -> DataFrame:
    """The mean of the neighbourhood; beyond an edge the edge's value counts."""
    line = Window.partitionBy(*keys).orderBy(pos)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(radius + 1) - F.row_number().over(line), F.lit(0))
    after = F.greatest(F.lit(radius) - (F.count("*").over(whole) - F.row_number().over(line)), F.lit(0))
    total = F.sum(value).over(line.rowsBetween(-radius, radius)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return profile.withColumn("smooth", total / (2 * radius + 1))


def running_median(profile: DataFrame, keys: Sequence[str], pos: str, value: str, radius: int = 2) -> DataFrame:
    """The median of the neighbourhood; beyond an edge the edge's value counts."""
    w = Window.partitionBy(*keys).orderBy(pos)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = [F.coalesce(F.lag(value, k).over(w), first) if k > 0 else F.coalesce(F.lead(value, -k).over(w), last) if k < 0 else F.col(value) for k in range(-radius, radius + 1)]
    return profile.withColumn("smooth", F.element_at(F.array_sort(F.array(*near)), radius + 1))


def gaussian(profile: DataFrame, keys: Sequence[str], pos: str, value: str, sigma: float) -> DataFrame:
    """Each profile weighed with a Gaussian of radius floor(4 sigma + 1/2); beyond an edge it goes on as in a mirror whose
    first row is the edge's own. Places count from 0 without gaps.

    Every place is sent to where it is seen, a fixed number of rows, so this is one equi-join and one aggregation."""
    radius = int(4 * sigma + 0.5)
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1))
    n = profile.groupBy(*keys).agg(F.count("*").cast("int").alias("n_"))
    asks = profile.join(n, list(keys)).select(*keys, F.col(pos).alias("at_"), "n_", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("k_"))
    # twice the length is the mirror's period
    folded = F.pmod(F.col("at_") + F.col("k_"), 2 * F.col("n_"))
    seen = F.when(folded >= F.col("n_"), 2 * F.col("n_") - 1 - folded).otherwise(folded)
    asks = asks.select(*keys, "at_", seen.alias(pos), (F.exp(-0.5 * F.pow(F.col("k_") / sigma, F.lit(2.0))) / total).alias("w_"))
    return asks.join(profile.select(*keys, F.col(pos).cast(asks.schema[pos].dataType).alias(pos), value), [*keys, pos]).groupBy(*keys, F.col("at_").alias(pos)).agg(F.sum(F.col("w_") * F.col(value)).alias("smooth"))


def distance_confidence(df: DataFrame, keys: Sequence[str], label: str, distance: str) -> DataFrame:
    """The nearest label of each key (the smaller of equals) and its confidence, 1 - sqrt(d1 / d2) of the two least
    distances; 1 if the second is next to nothing or missing."""
    rows = df.select(*keys, F.struct(F.col(distance).alias("d"), F.col(label).alias("l")).alias("s_")).withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy("s_"))).where("k_ <= 2")
    out = rows.groupBy(*keys).agg(F.min("s_").alias("a_"), F.max(F.when(F.col("k_") == 2, F.col("s_.d"))).alias("d2"))
    sure = F.when(F.coalesce("d2", F.lit(0.0)) <= 1e-9, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(F.col("a_.d") / F.col("d2")))))
    return out.select(*keys, F.col("a_.l").alias("best"), F.col("a_.d").alias("d1"), "d2", sure.alias("confidence"))


def top2_margin(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """The best and second value of each key, and their difference; the smaller label wins a tie.

    Only two rows a key are gathered; Spark limits each task's rows to two a key before it shuffles."""
    place = F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))
    rows = df.select(*keys, place.alias("s_")).withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy("s_"))).where("k_ <= 2")
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("s_")).alias("r"))
    second = F.coalesce(-F.get("r", F.lit(1))["v"], F.lit(0.0))
    return out.select(*keys, F.col("r")[0]["l"].alias("best"), (-F.col("r")[0]["v"]).alias("p1"), second.alias("p2"), (-F.col("r")[0]["v"] - second).alias("margin"))


def stitch_paragraphs(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs without text or drawing go; a hyphen after a letter at the end of one that text follows goes."""
    left = paragraphs.where((F.trim("text") != "") | F.col("has_drawing"))
    w = Window.partitionBy(key).orderBy("pos")
    joined = F.when(F.lead("text").over(w).isNotNull(), F.regexp_replace("text", r"(\p{L})-$", "$1")).otherwise(F.col("text"))
    return left.withColumn("text", joined)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; an aggregation, so nothing is sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, *[F.col("first")[c].alias(c) for c in rest])


def cumtrapz(profile: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """The running trapezoid sum, 0 at the first place."""
    w = Window.partitionBy(*keys).orderBy(pos)
    piece = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(pos) - F.lag(pos).over(w))
    return profile.withColumn("piece_", F.coalesce(piece, F.lit(0.0))).withColumn("area", F.sum("piece_").over(w)).drop("piece_")


def with_next_start(segments: DataFrame, key: str = "media_id", tail: float = 3.0) -> DataFrame:
    """A segment lasts until the next begins; the last one to its own end, or `tail` seconds."""
    w = Window.partitionBy(key).orderBy("start", "id")
    return segments.withColumn("until", F.coalesce(F.lead("start").over(w), F.col("end"), F.col("start") + tail))


def refine_parabolic(profile: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Where a parabola through each place and its neighbours peaks; the offset stays within half a step."""
    w = Window.partitionBy(*keys).orderBy(pos)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    bend = a - 2 * b + c
    offset = F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (a - c) / bend))).otherwise(0.0)
    return profile.withColumn("peak", F.col(pos) + F.coalesce(offset, F.lit(0.0)))


def circuit_intervals(requests: DataFrame, node: str = "node", order: Sequence[str] = ("ts", "event_id"), failures: int = 3, seconds: int = 15) -> DataFrame:
    """When a node's circuit opens: at each failure from the `failures`-th in a row on, for `seconds`."""
    counted = failures_in_row(requests, node, order, F.col("status_code") >= 500)
    return counted.where((F.col("failed") == 1) & (F.col("in_row") >= failures)).select(node, *order, "in_row", (F.col(order[0]) + F.expr(f"INTERVAL {seconds} SECONDS")).alias("open_until"))


def normalize_profile(profile: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Divided by the interpolated P95 of all values but the first and the last, between 0 and 1.5; where that isn't positive by their
    maximum, or 1. Profiles of two places or fewer stay as they are."""
    ends = profile.groupBy(*keys).agg(F.min(pos).alias("lo_"), F.max(pos).alias("hi_"), F.count("*").alias("n_"))
    rows = profile.join(ends, list(keys))
    inner = F.when((F.col(pos) > F.col("lo_")) & (F.col(pos) < F.col("hi_")), F.col(value))
    scale = rows.groupBy(*keys).agg(F.percentile(inner, 0.95).alias("p95_"), F.max(inner).alias("top_"))
    by = F.when(F.col("p95_") > 0, F.col("p95_")).when(F.col("top_") > 0, F.col("top_")).otherwise(1.0)
    norm = F.when(F.col("n_") <= 2, F.col(value)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.col(value) / (by + 1e-9))))
    return rows.join(scale, list(keys)).withColumn("norm", norm).select(*profile.columns, "norm")


def detrend_z(profile: DataFrame, keys: Sequence[str], pos: str, value: str, radius: int = 7) -> DataFrame:
    """How far each place stands out of the running median, in sigmas estimated by 1.4826 median |rest|."""
    rest = running_median(profile, keys, pos, value, radius).withColumn("rest_", F.col(value) - F.col("smooth"))
    sigma = rest.groupBy(*keys).agg((F.median(F.abs("rest_")) * 1.4826 + 1e-9).alias("sigma_"))
    return rest.join(sigma, list(keys)).select(*keys, pos, (F.col("rest_") / F.col("sigma_")).alias("z"))

"""Reports: one groupBy each, so partial aggregation runs before the shuffle and a hot key is no hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import is_whole_disk

from .quantiles import MOST, quantiles, small


def cpu_metrics(samples: DataFrame, key: str = "service", value: str = "cpu", most: int = MOST) -> DataFrame:
    """A1: average, maximum, nearest-rank P95, effective load and count; a service whose samples are all null gets zeros.

    Quantiles here and below are exact: of groups of up to `most` rows in the aggregation, of larger ones by distributed selection."""
    plain = [F.avg(value).alias("avg_cpu"), F.max(value).alias("max_cpu"), F.count(value).alias("samples")]
    if small(samples, [key], most):
        out = samples.groupBy(key).agg(*plain, F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95_cpu"))
    else:
        out = with_quantiles(samples.groupBy(key).agg(*plain), quantiles(samples, [key], value, [0.95], "disc", most), [key], ["p95_cpu"])
    zero = F.lit(0.0)
    return out.select(key, *[F.coalesce(c, zero).alias(c) for c in ("avg_cpu", "max_cpu", "p95_cpu")], F.coalesce(F.greatest(F.col("avg_cpu"), F.col("max_cpu") * 0.95), zero).alias("effective"), "samples")


def with_quantiles(groups: DataFrame, found: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """groups with the places of the array q of found; both have a row a group, and null groups meet."""
    own = found.select(*[F.col(c).alias(f"{c}_of") for c in by], "q")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]
    return groups.join(own, same, "left").select(*groups.columns, *[F.get("q", F.lit(k)).alias(name) for k, name in enumerate(names)])


def latency_report(requests: DataFrame, by: Sequence[str], value: str = "duration_ms", ts: str = "ts", method: str = "exact", accuracy: int = 10_000, most: int = MOST) -> DataFrame:
    """A2: count, rate a second, spread, and percentiles: exact ones, linearly interpolated; approximate ones hold a sketch of
    some accuracy entries and give a value whose rank is within n / accuracy."""
    points, names = [0.5, 0.9, 0.95, 0.99], ["p50", "p90", "p95", "p99"]
    span = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    plain = [
        F.count("*").alias("n"), (F.count("*") * 1e6 / F.nullif(span, F.lit(0))).alias("per_second"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"),
    ]
    if method == "exact" and not small(requests, by, most):
        return with_quantiles(requests.groupBy(*by).agg(*plain), quantiles(requests, by, value, points, "linear", most), by, names)
    q = F.percentile(value, points) if method == "exact" else F.percentile_approx(value, points, accuracy)
    out = requests.groupBy(*by).agg(*plain, q.alias("q"))
    return out.select(*by, "n", "per_second", "low", "high", "mean", "stdev", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])


def floor_rank_percentile(requests: DataFrame, by: str, p: float, value: str = "duration_ms") -> DataFrame:
    """A2: the value at place floor(n p) of each group, from 0, by distributed selection."""
    return quantiles(requests, [by], value, [p], "floor").select(by, F.get("q", F.lit(0)).alias("value"))


def node_distribution(requests: DataFrame, node: str = "node") -> DataFrame:
    """A3: one row: nodes, requests, the fullest node, and the variance against even shares."""
    each = requests.groupBy(node).agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("nodes"), F.sum("n").alias("requests"), F.max("n").alias("peak"), F.var_pop("n").alias("variance"))


def severity_counts(findings: DataFrame, logs: DataFrame) -> DataFrame:
    """A4: findings by mapped severity, and a total that counts all log issues as one."""
    s = F.upper(F.coalesce("severity", F.lit("")))
    level = F.when(F.col("tool") == "secrets", "high").when(s == "ERROR", "high").when(s == "WARNING", "medium").when(s.isin("CRITICAL", "HIGH", "MEDIUM"), F.lower(s)).otherwise("low")
    counts = findings.groupBy(level.alias("severity")).agg(F.count("*").alias("n"))
    logged = logs.limit(1).select(F.lit(1).cast("long").alias("n"))
    total = counts.select("n").union(logged).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("severity"), "n")
    return counts.unionByName(total)


def cleanup_summary(expired: DataFrame) -> DataFrame:
    """A5: files and bytes to go."""
    return expired.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def cache_hits(spans: DataFrame) -> DataFrame:
    """Hits, misses, errors and mean duration for each cache operation of spans (operation, outcome, duration_ms)."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return spans.groupBy("operation").agg(count("hit").alias("hits"), count("miss").alias("misses"), count("error").alias("errors"), F.avg("duration_ms").alias("mean_ms"))


def throughput_summary(runs: DataFrame) -> DataFrame:
    """Wall time, mean latency and successes for each concurrency; queued if the wall takes over one and a half mean latencies."""
    ok = F.col("success")
    out = runs.groupBy("concurrency").agg(F.max("latency").alias("wall"), F.avg(F.when(ok, F.col("latency"))).alias("mean_latency"), F.count_if(ok).alias("successes"), F.avg(F.when(ok, F.col("rtf"))).alias("mean_rtf"))
    return out.withColumn("queued", F.coalesce(F.col("wall") > 1.5 * F.col("mean_latency"), F.lit(False)))


def outcome_counts(requests: DataFrame, by: str) -> DataFrame:
    """Completed, failed and active requests."""
    count = lambda name: F.count_if(F.col("status") == name).alias(name)
    return requests.groupBy(by).agg(count("completed"), count("failed"), count("active"))


def full_text(segments: DataFrame, sep: str = " ", key: str = "media_id") -> DataFrame:
    """A medium's segments in order as one text; a medium is bounded by its length, so the list is small."""
    ordered = F.sort_array(F.collect_list(F.struct("id", "text")))
    return segments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), sep).alias("text"))


def sessions_by_user(sessions: DataFrame) -> DataFrame:
    """A10."""
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"))


def io_totals(devices: DataFrame) -> DataFrame:
    """Per host and time, bytes of whole disks and of networks but the loopback; devices (host, ts, kind, device, read, written)."""
    counted = ((F.col("kind") == "disk") & is_whole_disk(F.col("device"))) | ((F.col("kind") == "net") & (F.col("device") != "lo"))
    return devices.where(counted).groupBy("host", "ts", "kind").agg(F.sum("read").alias("read"), F.sum("written").alias("written"))


def order_stats(values: DataFrame, by: str, value: str, most: int = MOST) -> DataFrame:
    """Median, interpolated P95 of the positive values, and the MAD estimate of sigma."""
    if small(values, [by], most):
        middle = values.groupBy(by).agg(F.median(value).alias("median"), F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.95).alias("p95_positive"))
        spread = values.join(middle, by).groupBy(by).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad_sigma"))
        return middle.join(spread, by).select(by, "median", "p95_positive", "mad_sigma")
    one = lambda df, of, p, name: quantiles(df, [by], of, [p], "linear", most).select(by, F.get("q", F.lit(0)).alias(name))
    middle = one(values, value, 0.5, "median")
    high = one(values.withColumn("up_", F.when(F.col(value) > 0, F.col(value))), "up_", 0.95, "p95_positive")
    off = values.join(middle, by).withColumn("off_", F.abs(F.col(value) - F.col("median")))
    return middle.join(high, by).join(one(off, "off_", 0.5, "mad_"), by).select(by, "median", "p95_positive", (1.4826 * F.col("mad_")).alias("mad_sigma"))


def uniform_histogram(values: DataFrame, by: str, value: str, most: float = 64.0, width: float = 0.5) -> DataFrame:
    """Non-empty bins of [0, most] with their centres."""
    bins = int(most / width) + 1
    place = F.least(F.floor(F.col(value) / most * bins), F.lit(bins - 1)).cast("int")
    counted = values.where((F.col(value) >= 0) & (F.col(value) <= most)).groupBy(by, place.alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("centre", (F.col("bin") + 0.5) * most / bins)


def comb_scores(histogram: DataFrame, by: str, steps: Sequence[float]) -> DataFrame:
    """How well the bins' centres lie on multiples of each step; steps are a fixed list, exploded into the rows."""
    rows = histogram.withColumn("step", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    wave = F.cos(F.lit(2 * 3.141592653589793) * F.col("centre") / F.col("step"))
    return rows.groupBy(by, "step").agg((F.sum(F.col("n") * wave) / F.sum("n")).alias("score"))


def audit_summary(results: DataFrame) -> DataFrame:
    """One row of counts by outcome (server errors are 500, 502 and 503), and the memory's drift from the first result to the last. Schema violations and
    leaks are counted if results have schema_valid and sanitization (a text that says LEAKED or EXPLOIT)."""
    count = lambda c: F.count_if(c)
    s = F.col("status")
    drift = F.max_by("memory_mb", F.struct("ts", "id")) - F.min_by("memory_mb", F.struct("ts", "id"))
    more = []
    if "schema_valid" in results.columns:
        more.append(count(~F.col("schema_valid")).alias("schema_violations"))
    if "sanitization" in results.columns:
        more.append(count(F.col("sanitization").contains("LEAKED") | F.col("sanitization").contains("EXPLOIT")).alias("leaks"))
    return results.agg(
        count((s == 200) & F.col("safe")).alias("clean"), count(s.isin(400, 415, 422) & F.col("safe")).alias("blocked"), count(F.col("crashed")).alias("crashes"),
        count(s.isin(500, 502, 503)).alias("server_errors"), count(~F.col("safe")).alias("unsafe"), drift.alias("memory_drift"), *more,
    )


def detection_accuracy(truth: DataFrame, grids: DataFrame, by: str = "kind", most: int = MOST) -> DataFrame:
    """Exact and nearly exact sizes, mean and P95 latency for each kind of distortion."""
    both = truth.join(grids, "image_id")
    off = F.greatest(F.abs(F.col("cols") - F.col("true_cols")), F.abs(F.col("rows") - F.col("true_rows")))
    share = lambda c: F.avg(c.cast("int"))
    plain = [share(off == 0).alias("exact"), share(off <= 1).alias("within_one"), F.avg("latency_ms").alias("mean_ms")]
    if small(both, [by], most):
        return both.groupBy(by).agg(*plain, F.percentile("latency_ms", 0.95).alias("p95_ms"))
    return with_quantiles(both.groupBy(by).agg(*plain), quantiles(both, [by], "latency_ms", [0.95], "linear", most), [by], ["p95_ms"])


def int_median(values: DataFrame, by: str, value: str, most: int = MOST) -> DataFrame:
    """The median of whole numbers, of an even count the mean of the middle two without its fraction."""
    return quantiles(values, [by], value, [0.5], "linear", most).select(by, F.get("q", F.lit(0)).cast("long").alias("median"))

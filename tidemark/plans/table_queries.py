"""Queries of the joins, aggregates, windows, rankings and set operations over the stand-in views, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import ranking as L
from tidemark.operators import windows as W

from .standins import view

C = F.col
#: Sums of doubles differ in the last digits between engines, so results are rounded on both sides.
DIGITS = 6
NOON = "TIMESTAMP '2024-01-01 02:00:00'"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else C(c) for c, t in df.dtypes])


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def now():
    return F.to_timestamp_ntz(F.lit("2024-01-01 02:00:00"))


def profile(spark, d):
    """One row for each place of a vector, as a profile of whole numbers."""
    v = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return v.select("vec_id", "pos", F.floor(F.abs(C("x").cast("double")) * 1000).cast("double").alias("v"))


PROFILE = "(SELECT vec_id, pos, floor(abs(x::DOUBLE) * 1000) AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"


def node_report(spark, d) -> DataFrame:
    """Which node is slow, and how slow: percentiles, moving average and openings of its circuit."""
    requests = view(spark, d, "requests")
    report = A.latency_report(requests, ["node"]).select("node", "n", "mean", "p50", "p95", "p99")
    opened = W.circuit_intervals(requests).groupBy("node").agg(F.count("*").alias("openings"), F.max("in_row").cast("long").alias("longest"))
    return rounded(report.join(W.ewma_latency(requests), "node").join(opened, "node", "left").na.fill(0, ["openings", "longest"]))


EWMA = """
    SELECT node, ewma FROM (SELECT node, k, 15 * pow(0.8, k) + sum(0.2 * duration_ms * pow(0.8, k - i)) OVER (PARTITION BY node) AS ewma, i FROM
      (SELECT node, duration_ms, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY node) AS k FROM {requests})) WHERE i = k"""
CIRCUIT = """
    SELECT node, ts, event_id, in_row, ts + INTERVAL 15 SECOND AS open_until FROM (
      SELECT node, ts, event_id, f, sum(f) OVER (PARTITION BY node, island ORDER BY ts, event_id)::BIGINT AS in_row FROM (
        SELECT node, ts, event_id, f, sum(1 - f) OVER (PARTITION BY node ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN status_code >= 500 THEN 1 ELSE 0 END AS f FROM {requests}))) WHERE f = 1 AND in_row >= 3"""


def tokens(spark, d):
    return view(spark, d, "sessions").select(C("firebase_token").alias("token"), F.concat(F.lit("fb"), (C("user_id") % 400).cast("string")).alias("uid")).where("id % 3 = 0")


def services(spark, d):
    p = read(spark, d, "part")
    return p.select(C("p_partkey").alias("service_id"), F.concat(F.lit("stack"), (C("p_partkey") % 7).cast("string"), F.lit("_"), F.regexp_replace("p_name", " ", "_")).alias("name"), F.when(C("p_partkey") % 4 > 0, C("p_size")).alias("replicas"))


def config(spark, d):
    return read(spark, d, "part").select(F.element_at(F.split("p_name", " "), -1).alias("service")).union(read(spark, d, "part").select(F.regexp_replace("p_name", " ", "_"))).distinct()


def times(spark, d):
    return read(spark, d, "conversations").select(C("conv_id").alias("media_id"), (C("turn") * 7.5).alias("t"))


def runs(spark, d):
    e = read(spark, d, "events")
    return e.select((C("user_id") % 5 + 1).alias("concurrency"), C("value").alias("latency"), (C("event_type") != "error").alias("success"), (C("value") / 60).alias("rtf"))


def paragraphs(spark, d):
    p = read(spark, d, "conversations").select(C("conv_id").alias("doc_id"), C("turn").alias("pos"), F.when(C("turn") % 5 == 4, F.lit(" ")).when(C("turn") % 2 == 0, F.concat("text", F.lit("x-"))).otherwise(C("text")).alias("text"), (C("turn") % 10 == 9).alias("has_drawing"))
    return p


def audit(spark, d):
    r = view(spark, d, "requests")
    return r.select(C("event_id").alias("id"), "ts", C("status_code").alias("status"), (C("event_id") % 4 > 0).alias("safe"), (C("event_id") % 50 == 0).alias("crashed"), C("duration_ms").alias("memory_mb"))


QUERIES = {
    "node_report": (
        node_report,
        f"""WITH e AS ({EWMA}), c AS ({CIRCUIT})
        SELECT r.node, n, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(ewma, 6) AS ewma, coalesce(openings, 0) AS openings, coalesce(longest, 0) AS longest
        FROM (SELECT node, count(*) AS n, avg(duration_ms) AS mean, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99 FROM {{requests}} GROUP BY node) r
        JOIN e ON r.node = e.node LEFT JOIN (SELECT node, count(*) AS openings, max(in_row) AS longest FROM c GROUP BY node) c ON r.node = c.node""",
    ),
    "a1_cpu_metrics": (
        lambda s, d: rounded(A.cpu_metrics(view(s, d, "samples"))),
        "SELECT service, round(avg(cpu), 6) AS avg_cpu, round(max(cpu), 6) AS max_cpu, round(quantile_disc(cpu, 0.95), 6) AS p95_cpu, round(greatest(avg(cpu), 0.95 * max(cpu)), 6) AS effective, count(cpu) AS samples FROM {samples} GROUP BY service",
    ),
    "a2_latency_report": (
        lambda s, d: rounded(A.latency_report(view(s, d, "requests"), ["node", "method"])),
        """SELECT node, method, count(*) AS n, round(count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS per_second, round(min(duration_ms), 6) AS low, round(max(duration_ms), 6) AS high, round(avg(duration_ms), 6) AS mean, round(stddev_samp(duration_ms), 6) AS stdev,
        round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.9), 6) AS p90, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM {requests} GROUP BY node, method""",
    ),
    "a2_floor_rank": (
        lambda s, d: A.floor_rank_percentile(view(s, d, "requests"), "node", 0.99),
        "SELECT node, duration_ms AS value FROM (SELECT node, duration_ms, row_number() OVER (PARTITION BY node ORDER BY duration_ms) - 1 AS k, count(*) OVER (PARTITION BY node) AS n FROM {requests}) WHERE k = floor(n * 0.99)",
    ),
    "a3_node_distribution": (lambda s, d: rounded(A.node_distribution(view(s, d, "requests"))), "SELECT count(*) AS nodes, sum(n)::BIGINT AS requests, max(n) AS peak, round(var_pop(n), 6) AS variance FROM (SELECT node, count(*) AS n FROM {requests} GROUP BY node)"),
    "a4_severity_counts": (
        lambda s, d: A.severity_counts(view(s, d, "findings"), view(s, d, "requests").where("status_code >= 500")),
        """WITH c AS (SELECT CASE WHEN tool = 'secrets' OR upper(severity) = 'ERROR' THEN 'high' WHEN upper(severity) = 'WARNING' THEN 'medium' WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN lower(severity) ELSE 'low' END AS severity, count(*) AS n FROM {findings} GROUP BY 1)
        SELECT severity, n FROM c UNION ALL SELECT 'total', ((SELECT sum(n) FROM c) + (SELECT count(*) > 0 FROM {requests} WHERE status_code >= 500)::INT)::BIGINT""",
    ),
    "a5_cleanup_summary": (
        lambda s, d: A.cleanup_summary(J.expired_files(view(s, d, "files"), view(s, d, "jobs"), now())),
        f"SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM {{files}} WHERE epoch({NOON}) - epoch(mtime) > CASE WHEN in_tmp OR ends_with(filename, '.part') THEN 1800 ELSE 3600 END",
    ),
    "a5_cleanup_protected": (
        lambda s, d: A.cleanup_summary(J.expired_files(view(s, d, "files"), view(s, d, "files").where("doc_id % 6 = 1").select("filename", F.when(C("doc_id") % 12 == 1, "downloading").otherwise("completed").alias("status")), now())),
        f"SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM {{files}} WHERE epoch({NOON}) - epoch(mtime) > CASE WHEN in_tmp OR ends_with(filename, '.part') THEN 1800 ELSE 3600 END AND (in_tmp OR filename NOT IN (SELECT filename FROM {{files}} WHERE doc_id % 12 = 1))",
    ),
    "a6_cache_hits": (
        lambda s, d: rounded(A.cache_hits(read(s, d, "events").select(F.concat(F.lit("op"), C("user_id") % 3).alias("operation"), F.when(C("event_type") == "error", "error").when(C("event_id") % 3 == 0, "miss").otherwise("hit").alias("outcome"), C("value").alias("duration_ms")))),
        "SELECT 'op' || user_id % 3 AS operation, count(*) FILTER (event_type <> 'error' AND event_id % 3 > 0) AS hits, count(*) FILTER (event_type <> 'error' AND event_id % 3 = 0) AS misses, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1",
    ),
    "a7_throughput": (
        lambda s, d: rounded(A.throughput_summary(runs(s, d))),
        "SELECT user_id % 5 + 1 AS concurrency, round(max(value), 6) AS wall, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_latency, count(*) FILTER (event_type <> 'error') AS successes, round(avg(value / 60) FILTER (event_type <> 'error'), 6) AS mean_rtf, max(value) > 1.5 * avg(value) FILTER (event_type <> 'error') AS queued FROM events GROUP BY 1",
    ),
    "a8_outcome_counts": (
        lambda s, d: A.outcome_counts(view(s, d, "requests").withColumn("status", F.when(C("status_code") >= 400, "failed").when(C("event_id") % 5 == 0, "active").otherwise("completed")), "node"),
        "SELECT node, count(*) FILTER (status_code < 400 AND event_id % 5 > 0) AS completed, count(*) FILTER (status_code >= 400) AS failed, count(*) FILTER (status_code < 400 AND event_id % 5 = 0) AS active FROM {requests} GROUP BY node",
    ),
    "a9_full_text": (lambda s, d: A.full_text(view(s, d, "segments")), "SELECT media_id, string_agg(text, ' ' ORDER BY id) AS text FROM {segments} GROUP BY media_id"),
    "a10_sessions_by_user": (lambda s, d: A.sessions_by_user(view(s, d, "sessions")), "SELECT user_id, count(*) AS sessions FROM {sessions} GROUP BY user_id"),
    "a11_io_totals": (
        lambda s, d: A.io_totals(read(s, d, "events").select((C("user_id") % 9).alias("host"), F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.when(C("event_id") % 2 == 0, "disk").otherwise("net").alias("kind"), F.element_at(F.array(*map(F.lit, ("sda", "lo", "sda1", "eth0"))), (C("event_id") % 4 + 1).cast("int")).alias("device"), C("event_id").alias("read"), C("user_id").alias("written"))),
        "SELECT user_id % 9 AS host, ts::DATE::VARCHAR AS ts, CASE WHEN event_id % 2 = 0 THEN 'disk' ELSE 'net' END AS kind, sum(event_id)::BIGINT AS read, sum(user_id)::BIGINT AS written FROM events WHERE event_id % 4 IN (0, 3) GROUP BY 1, 2, 3",
    ),
    "a17_uniform_histogram": (
        lambda s, d: rounded(A.uniform_histogram(read(s, d, "events"), "event_type", "value")),
        "SELECT event_type, bin, count(*) AS n, round((bin + 0.5) * 64 / 129, 6) AS centre FROM (SELECT event_type, least(floor(value / 64.0 * 129), 128)::INT AS bin FROM events WHERE value >= 0 AND value <= 64) GROUP BY 1, 2",
    ),
    "a18_comb_scores": (
        lambda s, d: rounded(A.comb_scores(A.uniform_histogram(read(s, d, "events"), "event_type", "value"), "event_type", [4, 6, 8, 16])),
        "WITH h AS (SELECT event_type, (least(floor(value / 64.0 * 129), 128) + 0.5) * 64 / 129 AS c FROM events WHERE value >= 0 AND value <= 64) SELECT event_type, step, round(avg(cos(2 * pi() * c / step)), 6) AS score FROM h, (VALUES (4.0::DOUBLE), (6.0), (8.0), (16.0)) v(step) GROUP BY 1, 2",
    ),
    "a19_order_stats": (
        lambda s, d: rounded(A.order_stats(profile(s, d), "vec_id", "v")),
        f"""WITH p AS {PROFILE}, m AS (SELECT vec_id, median(v) AS med, quantile_cont(v, 0.95) FILTER (v > 0) AS p95 FROM p GROUP BY vec_id)
        SELECT m.vec_id, round(any_value(med), 6) AS median, round(any_value(p95), 6) AS p95_positive, round(1.4826 * median(abs(v - med)), 6) AS mad_sigma FROM p JOIN m ON p.vec_id = m.vec_id GROUP BY m.vec_id""",
    ),
    "a31_audit_summary": (
        lambda s, d: rounded(A.audit_summary(audit(s, d))),
        """SELECT count(*) FILTER (status_code = 200 AND event_id % 4 > 0) AS clean, count(*) FILTER (status_code IN (400, 415, 422) AND event_id % 4 > 0) AS blocked, count(*) FILTER (event_id % 50 = 0) AS crashes, count(*) FILTER (status_code IN (500, 502, 503)) AS server_errors,
        count(*) FILTER (event_id % 4 = 0) AS unsafe, round(arg_max(duration_ms, (ts, event_id)) - arg_min(duration_ms, (ts, event_id)), 6) AS memory_drift FROM {requests}""",
    ),
    "a32_detection_accuracy": (
        lambda s, d: rounded(A.detection_accuracy(read(s, d, "part").select(C("p_partkey").alias("image_id"), C("p_type").alias("kind"), C("p_size").alias("true_cols"), C("p_size").alias("true_rows")), read(s, d, "part").select(C("p_partkey").alias("image_id"), (C("p_size") + C("p_partkey") % 3).alias("cols"), C("p_size").alias("rows"), C("p_retailprice").alias("latency_ms")))),
        "SELECT p_type AS kind, round(avg((p_partkey % 3 = 0)::INT), 6) AS exact, round(avg((p_partkey % 3 <= 1)::INT), 6) AS within_one, round(avg(p_retailprice), 6) AS mean_ms, round(quantile_cont(p_retailprice, 0.95), 6) AS p95_ms FROM part GROUP BY 1",
    ),
    "w1_latest_state": (
        lambda s, d: W.latest_state(view(s, d, "job_events"), "job_id", ["seq", "part", "supp", "price"]).drop("supp"),
        "SELECT job_id, seq, part, price, status, percent, error FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC, part DESC, supp DESC, price DESC) AS r FROM {job_events}) WHERE r = 1",
    ),
    "w2_change_feed": (
        lambda s, d: W.change_feed(view(s, d, "job_events"), "job_id", ["seq", "part", "supp", "price"], "changes", ["status"]).select("job_id", "seq", "part", "status", "percent"),
        """SELECT job_id, seq, part, status, percent FROM (SELECT *, lag(status) OVER w AS p, row_number() OVER w AS k FROM (
          SELECT *, coalesce(max((status IN ('completed', 'error'))::INT) OVER (PARTITION BY job_id ORDER BY seq, part, supp, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM {job_events}) WHERE ended = 0
          WINDOW w AS (PARTITION BY job_id ORDER BY seq, part, supp, price)) WHERE k = 1 OR status IS DISTINCT FROM p""",
    ),
    "w2_feed_all": (
        lambda s, d: W.change_feed(view(s, d, "job_events"), "job_id", ["seq", "part", "supp", "price"], "all").groupBy("job_id").agg(F.count("*").alias("n")),
        "SELECT job_id, count(*) AS n FROM (SELECT job_id, coalesce(max((status IN ('completed', 'error'))::INT) OVER (PARTITION BY job_id ORDER BY seq, part, supp, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM {job_events}) WHERE ended = 0 GROUP BY job_id",
    ),
    "w3_apply_updates": (
        lambda s, d: W.apply_updates(view(s, d, "job_events"), "job_id", ["seq", "part", "supp", "price"]),
        """SELECT job_id, seq, part, supp, price, status, percent FROM (SELECT job_id, seq, part, supp, price, st AS status, percent,
          coalesce(max((st IN ('completed', 'error', 'cancelled'))::INT) OVER (PARTITION BY job_id ORDER BY seq, part, supp, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_
          FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' ELSE status END AS st FROM {job_events})) WHERE over_ = 0""",
    ),
    "w5_ewma": (lambda s, d: rounded(W.ewma_latency(view(s, d, "requests"))), f"SELECT node, round(ewma, 6) AS ewma FROM ({EWMA})"),
    "w6_load_score": (
        lambda s, d: rounded(W.load_score(view(s, d, "requests"), W.ewma_latency(view(s, d, "requests")).withColumn("ewma", F.round("ewma", 3))), 3),
        f"""WITH e AS ({EWMA}), s AS (SELECT node, event_id, epoch_us(ts) AS t0, 1 AS step FROM {{requests}} UNION ALL SELECT node, event_id, epoch_us(ts) + trunc(duration_ms * 1000)::BIGINT, -1 FROM {{requests}}),
        a AS (SELECT *, sum(step) OVER (PARTITION BY node ORDER BY t0, step, event_id)::BIGINT AS active FROM s) SELECT a.node, event_id, active, round((active + 1) * round(ewma, 3), 3) AS score FROM a JOIN e ON a.node = e.node WHERE step = 1""",
    ),
    "w7_counter_rates": (
        lambda s, d: rounded(W.counter_rates(view(s, d, "counters"), ["host"], "ts", ["bytes"], ["event_id"]), 4).select("host", F.unix_micros(C("ts").cast("timestamp")).alias("at"), "bytes_rate"),
        "SELECT host, epoch_us(ts) AS at, round(greatest(bytes - lag(bytes) OVER w, 0) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6), 4) AS bytes_rate FROM {counters} WINDOW w AS (PARTITION BY host ORDER BY ts)",
    ),
    "w7_busy_percent": (
        lambda s, d: rounded(W.busy_percent(view(s, d, "counters"), ["host"], "ts", ["event_id"])).select("host", F.unix_micros(C("ts").cast("timestamp")).alias("at"), "busy"),
        "SELECT host, epoch_us(ts) AS at, CASE WHEN total - lag(total) OVER w > 0 THEN round(least(greatest(100.0 * (1 - (idle - lag(idle) OVER w) / (total - lag(total) OVER w)::DOUBLE), 0), 100), 6) END AS busy FROM {counters} WINDOW w AS (PARTITION BY host ORDER BY ts)",
    ),
    "w8_group_lines": (
        lambda s, d: W.group_lines(read(s, d, "conversations"), "conv_id", "turn", C("role") == "user").select("conv_id", "turn", C("segment").cast("long").alias("segment")),
        "SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS segment FROM conversations",
    ),
    "w9_derivatives": (
        lambda s, d: W.derivatives(profile(s, d), ["vec_id"], "pos", "v"),
        f"SELECT vec_id, pos, abs(v - lag(v) OVER w) AS d1, abs(lead(v) OVER w - 2 * v + lag(v) OVER w) AS d2 FROM {PROFILE} WINDOW w AS (PARTITION BY vec_id ORDER BY pos)",
    ),
    "w9_lag_diffs": (
        lambda s, d: W.lag_diffs(profile(s, d).where("v > 150"), ["vec_id"], "pos"),
        f"SELECT vec_id, pos, k::INT AS lag, (other - pos)::INT AS diff FROM (SELECT vec_id, pos, unnest([lead(pos, 1) OVER w, lead(pos, 2) OVER w, lead(pos, 3) OVER w, lead(pos, 4) OVER w]) AS other, unnest([1, 2, 3, 4]) AS k FROM {PROFILE} WHERE v > 150 WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) WHERE other - pos BETWEEN 2 AND 64",
    ),
    "w10_box_mean": (
        lambda s, d: rounded(W.box_mean(profile(s, d), ["vec_id"], "pos", "v")),
        f"WITH p AS {PROFILE} SELECT p.vec_id, p.pos, p.v, round(avg(o.v), 6) AS smooth FROM p, range(-3, 4) r(k), p o WHERE o.vec_id = p.vec_id AND o.pos = least(greatest(p.pos + k, 0), 63) GROUP BY 1, 2, 3",
    ),
    "w10_running_median": (
        lambda s, d: W.running_median(profile(s, d), ["vec_id"], "pos", "v"),
        f"SELECT vec_id, pos, v, list_sort([coalesce(lag(v, 2) OVER w, f), coalesce(lag(v, 1) OVER w, f), v, coalesce(lead(v, 1) OVER w, l), coalesce(lead(v, 2) OVER w, l)])[3] AS smooth FROM (SELECT *, first_value(v) OVER (PARTITION BY vec_id ORDER BY pos) AS f, first_value(v) OVER (PARTITION BY vec_id ORDER BY pos DESC) AS l FROM {PROFILE}) WINDOW w AS (PARTITION BY vec_id ORDER BY pos)",
    ),
    "w12_top2_margin": (
        lambda s, d: W.top2_margin(profile(s, d), ["vec_id"], "pos", "v"),
        f"SELECT vec_id, max(pos) FILTER (r = 1) AS best, max(v) FILTER (r = 1) AS p1, max(v) FILTER (r = 2) AS p2, max(v) FILTER (r = 1) - max(v) FILTER (r = 2) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS r FROM {PROFILE}) GROUP BY vec_id",
    ),
    "w13_stitch_paragraphs": (
        lambda s, d: W.stitch_paragraphs(paragraphs(s, d)),
        r"""WITH p AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN turn % 5 = 4 THEN ' ' WHEN turn % 2 = 0 THEN text || 'x-' ELSE text END AS text, turn % 10 = 9 AS has_drawing FROM conversations)
        SELECT doc_id, pos, CASE WHEN lead(text) OVER w IS NOT NULL THEN regexp_replace(text, '(\p{L})-$', '\1') ELSE text END AS text, has_drawing FROM p WHERE trim(text) <> '' OR has_drawing WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    ),
    "w14_first_wins": (
        lambda s, d: W.first_wins(view(s, d, "requests").select("path", "event_id", "node"), ["path"], ["event_id"]),
        "SELECT path, min(event_id) AS event_id, arg_min(node, event_id) AS node FROM {requests} GROUP BY path",
    ),
    "w15_cumtrapz": (
        lambda s, d: W.cumtrapz(profile(s, d), ["vec_id"], "pos", "v"),
        f"SELECT vec_id, pos, v, sum(p) OVER (PARTITION BY vec_id ORDER BY pos) AS area FROM (SELECT *, coalesce((v + lag(v) OVER w) / 2, 0) AS p FROM {PROFILE} WINDOW w AS (PARTITION BY vec_id ORDER BY pos))",
    ),
    "w16_next_start": (
        lambda s, d: rounded(W.with_next_start(view(s, d, "segments")).select("media_id", "id", "until")),
        'SELECT media_id, id, round(coalesce(lead(start) OVER (PARTITION BY media_id ORDER BY start, id), "end", start + 3), 6) AS until FROM {segments}',
    ),
    "w17_parabolic": (
        lambda s, d: rounded(W.refine_parabolic(profile(s, d), ["vec_id"], "pos", "v").select("vec_id", "pos", "peak")),
        f"SELECT vec_id, pos, round(pos + coalesce(CASE WHEN abs(a - 2 * v + c) > 1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * v + c))) ELSE 0 END, 0), 6) AS peak FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c FROM {PROFILE} WINDOW w AS (PARTITION BY vec_id ORDER BY pos))",
    ),
    "w18_circuit": (
        lambda s, d: W.circuit_intervals(view(s, d, "requests")).select("node", "event_id", C("in_row").cast("long").alias("in_row"), F.unix_micros(C("open_until").cast("timestamp")).alias("open_until")),
        f"SELECT node, event_id, in_row, epoch_us(open_until) AS open_until FROM ({CIRCUIT})",
    ),
    "w19_normalize": (
        lambda s, d: rounded(W.normalize_profile(profile(s, d), ["vec_id"], "pos", "v")),
        f"WITH p AS {PROFILE}, t AS (SELECT vec_id, quantile_cont(v, 0.95) AS q, max(v) AS m FROM p WHERE pos BETWEEN 1 AND 62 GROUP BY vec_id) SELECT p.vec_id, pos, v, round(greatest(0, least(1.5, v / (CASE WHEN q > 0 THEN q WHEN m > 0 THEN m ELSE 1 END + 1e-9))), 6) AS norm FROM p JOIN t ON p.vec_id = t.vec_id",
    ),
    "j1_find_cached": (
        lambda s, d: J.find_cached(view(s, d, "file_requests"), view(s, d, "files"), now()).select("request_id", "cached"),
        f"""SELECT request_id, min(filename) AS cached FROM {{file_requests}} r LEFT JOIN {{files}} f ON starts_with(filename, substr(md5(r.url || '_mp3_320'), 1, 10)) AND ends_with(filename, '.mp3') AND epoch({NOON}) - epoch(mtime) < 3600 GROUP BY request_id""",
    ),
    "j1_find_cached_service": (
        lambda s, d: J.find_cached(view(s, d, "file_requests"), view(s, d, "files").withColumn("size", F.when(C("doc_id") % 3 > 0, C("size")).otherwise(0)), now(), "service").select("request_id", "cached"),
        f"""SELECT request_id, min(filename) AS cached FROM {{file_requests}} r LEFT JOIN {{files}} f ON starts_with(filename, substr(md5(r.url || '_mp3_320'), 1, 10)) AND ends_with(filename, '.mp3') AND epoch({NOON}) - epoch(mtime) < 3600 AND doc_id % 3 > 0 AND size > 0 GROUP BY request_id""",
    ),
    "j1_find_cached_worker": (
        lambda s, d: J.find_cached(view(s, d, "file_requests"), view(s, d, "files"), now(), "worker").select("request_id", "cached"),
        """SELECT request_id, min(filename) AS cached FROM {file_requests} r LEFT JOIN {files} f ON starts_with(filename, substr(md5(r.url || '_mp3_320'), 1, 10)) AND ends_with(filename, '.mp3') AND size > 1024 GROUP BY request_id""",
    ),
    "j2_expired_files": (
        lambda s, d: J.expired_files(view(s, d, "files"), view(s, d, "files").where("doc_id % 6 = 1").select("filename", F.when(C("doc_id") % 12 == 1, "queued").otherwise("processing").alias("status")), now()).select("doc_id"),
        f"""SELECT doc_id FROM {{files}} WHERE epoch({NOON}) - epoch(mtime) > CASE WHEN in_tmp OR ends_with(filename, '.part') THEN 1800 ELSE 3600 END AND (in_tmp OR filename NOT IN (SELECT filename FROM {{files}} WHERE doc_id % 12 = 1))""",
    ),
    "j3_session_user": (
        lambda s, d: J.session_user(view(s, d, "sessions"), view(s, d, "users").where("id % 4 > 0"), F.to_timestamp_ntz(F.lit("1998-01-01"))).select("id", "user_id", "username"),
        "SELECT s.id, s.user_id, u.username FROM {sessions} s LEFT JOIN {users} u ON s.user_id = u.id AND u.id % 4 > 0 WHERE s.status = 'active' AND (s.expires_at IS NULL OR TIMESTAMP '1998-01-01' <= s.expires_at)",
    ),
    "j4_resolve_identity": (
        lambda s, d: J.resolve_identity(tokens(s, d), view(s, d, "users"), view(s, d, "sessions").where("id % 2 = 0")).select("token", "user_id", "session_id"),
        "SELECT t.firebase_token AS token, u.id AS user_id, s.id AS session_id FROM {sessions} t JOIN {users} u ON u.firebase_uid = 'fb' || t.user_id % 400 LEFT JOIN {sessions} s ON s.firebase_token = t.firebase_token AND s.id % 2 = 0 WHERE t.id % 3 = 0",
    ),
    "j5_containers_with_stats": (
        lambda s, d: J.containers_with_stats(read(s, d, "part").select(C("p_partkey").alias("container_id"), "p_name"), read(s, d, "part").where("p_partkey % 3 > 0").select(C("p_partkey").alias("container_id"), C("p_size").cast("double").alias("cpu"), C("p_retailprice").alias("memory_mb"))),
        "SELECT p_partkey AS container_id, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 0 END::DOUBLE AS cpu, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice ELSE 0 END AS memory_mb FROM part",
    ),
    "j6_missing_monitors": (lambda s, d: J.missing_monitors(view(s, d, "urls").select("page_id", "url"), view(s, d, "urls").where("page_id % 2 = 0")), "SELECT page_id, url FROM {urls} u WHERE NOT EXISTS (SELECT 1 FROM {urls} e WHERE e.page_id % 2 = 0 AND e.url = u.url)"),
    "j7_match_services": (
        lambda s, d: J.match_services(config(s, d), services(s, d)),
        """WITH s AS (SELECT p_partkey AS service_id, 'stack' || p_partkey % 7 || '_' || replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 4 > 0), c AS (SELECT DISTINCT unnest([string_split(p_name, ' ')[-1], replace(p_name, ' ', '_')]) AS service FROM part)
        SELECT service, arg_min(service_id, (name, service_id)) AS service_id, min(name) AS name FROM c JOIN s ON name = service OR ends_with(name, '_' || service) GROUP BY service""",
    ),
    "j8_active_segment": (
        lambda s, d: J.active_segment(times(s, d), view(s, d, "segments")),
        """WITH g AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY media_id ORDER BY start, id), "end", start + 3) AS until FROM {segments}), t AS (SELECT conv_id AS media_id, turn * 7.5::DOUBLE AS t FROM conversations)
        SELECT t.media_id, t.t, CASE WHEN t.t < until THEN id END AS id, CASE WHEN t.t < until THEN text END AS text FROM t ASOF LEFT JOIN g ON t.media_id = g.media_id AND t.t >= g.start""",
    ),
    "j13_span_tree": (
        lambda s, d: J.span_tree(view(s, d, "spans")).select("trace_id", "span_id", C("depth").cast("int").alias("depth")),
        "SELECT s.trace_id, s.span_id, t.depth FROM {spans} s JOIN t ON s.span_id = t.span_id",
    ),
    "l1_top_processes": (
        lambda s, d: L.top_rows(view(s, d, "samples"), ["service"], [F.desc("cpu"), "event_id"], 10).select("service", "event_id", "cpu", "rank"),
        "SELECT service, event_id, cpu, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY cpu DESC, event_id) AS rank FROM {samples}) WHERE rank <= 10",
    ),
    "l2_top_findings": (
        lambda s, d: L.top_findings(view(s, d, "findings").select("tool", "doc_id", "line"), "tool", [F.desc("line"), "doc_id"], 15),
        "SELECT tool, doc_id, line, rank::INT AS rank, greatest(n - 15, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY line DESC, doc_id) AS rank, count(*) OVER (PARTITION BY tool) AS n FROM {findings}) WHERE rank <= 15",
    ),
    "l3_divisors": (
        lambda s, d: L.divisor_candidates(read(s, d, "part").select("p_partkey", (C("p_size") + (C("p_partkey") % 4) * 0.3).alias("step"), (C("p_partkey") % 101).alias("sure")), "p_partkey", "step", "sure"),
        """WITH s AS (SELECT p_partkey, p_size + (p_partkey % 4) * 0.3::DOUBLE AS step, (p_partkey % 101)::INT AS sure FROM part),
        r AS (SELECT p_partkey, d AS size, abs(round(step / d) - step / d) AS diff, sure FROM s, (VALUES (1), (2), (3), (4), (6), (8), (12), (16)) v(d) WHERE d <> round(step)::INT),
        g AS (SELECT p_partkey, size, greatest(15, least(floor(greatest(20, 70 - 150 * diff))::INT, greatest(sure - 10, 0))) AS confidence FROM r WHERE diff < 0.15 UNION ALL SELECT p_partkey, round(step)::INT, sure FROM s WHERE round(step) >= 1)
        SELECT p_partkey, size, confidence, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY confidence DESC, size) AS rank FROM g) WHERE rank <= 5""",
    ),
    "l4_even_sample": (
        lambda s, d: L.even_sample(view(s, d, "samples"), ["service"], ["event_id"], 100).select("service", "event_id"),
        "SELECT service, event_id FROM (SELECT service, event_id, row_number() OVER (PARTITION BY service ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY service) AS n FROM {samples}) WHERE n <= 100 OR i IN (SELECT floor(k * (n - 1) / 99) FROM range(100) r(k))",
    ),
    "l5_tail": (
        lambda s, d: L.tail(view(s, d, "samples").select("service", "event_id"), ["service"], "event_id", 20),
        "SELECT service, event_id FROM (SELECT service, event_id, row_number() OVER (PARTITION BY service ORDER BY event_id DESC) AS r FROM {samples}) WHERE r <= 20",
    ),
    "l6_tile_grid": (
        lambda s, d: L.tile_grid(view(s, d, "images").select("image_id", "width", "height")),
        "SELECT image_id, x, y, least(512, width - x)::INT AS w, least(512, height - y)::INT AS h, (x * 2)::INT AS out_x, (y * 2)::INT AS out_y FROM (SELECT image_id, width, height, x, unnest(range(0, height, 512))::INT AS y FROM (SELECT image_id, width, height, unnest(range(0, width, 512))::INT AS x FROM {images}))",
    ),
    "u1_union_findings": (
        lambda s, d: L.union_findings(view(s, d, "findings").where("tool = 'code'").select("doc_id", "tool", "line"), view(s, d, "findings").where("tool = 'secrets'").select("tool", "doc_id", "path")),
        "SELECT doc_id, tool, line, NULL::VARCHAR AS path FROM {findings} WHERE tool = 'code' UNION ALL SELECT doc_id, tool, NULL, path FROM {findings} WHERE tool = 'secrets'",
    ),
}
QUERIES["j13_span_tree"] = (QUERIES["j13_span_tree"][0], "WITH t AS (SELECT trace_id, span_id, 0 AS depth FROM {spans} WHERE parent_span_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, t.depth + 1 FROM {spans} s JOIN t ON s.parent_span_id = t.span_id AND s.trace_id = t.trace_id) SELECT s.trace_id, s.span_id, t.depth FROM {spans} s LEFT JOIN t ON s.span_id = t.span_id AND s.trace_id = t.trace_id")

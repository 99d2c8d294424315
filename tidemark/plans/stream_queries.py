"""Queries of the ordered folds and event-time operators, in batch; the streams' equality with them is tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources.readers import load_scale_config
from tidemark.staging import folder
from tidemark.streaming import streams as T

from .standins import view
from .table_queries import read, rounded

C = F.col

def seconds():
    return F.unix_micros(C("ts").cast("timestamp")) / 1e6


def calls(spark, d):
    return view(spark, d, "requests").select((C("user_id") % 20).cast("string").alias("client"), "event_id", F.floor(seconds() / 1000).cast("double").alias("at"))


def feed(spark, d):
    e = view(spark, d, "job_events").groupBy("job_id", "seq").agg(F.min(F.struct("part", "supp", "price", "status", "percent")).alias("e"))
    return e.select("job_id", "seq", "e.status", C("e.percent").alias("percent"))


def nodes(spark, d):
    return view(spark, d, "requests").select("node", "event_id", seconds().alias("at"), "duration_ms", "status_code")


def logins(spark, d):
    return view(spark, d, "requests").select(F.concat(F.lit("k"), C("user_id") % 50).alias("token"), "ts", "event_id", C("forwarded").alias("agent"), C("real_ip").alias("ip"), F.when(C("event_id") % 4 == 0, C("path")).otherwise("").alias("name"), F.when(C("event_id") % 3 == 0, C("method")).alias("photo"))


def streamed(df, at: str, make, parts: int = 3):
    """What a stream gives that reads df from files in as many batches as parts, cut by the time `at`: files are added, and the stream
    reads what is new and stops, going on from its checkpoint each time."""
    spark, source, out, state = df.sparkSession, *(folder(df.sparkSession, f"stream-{x}") for x in ("in", "out", "state"))
    inner = df.approxQuantile(at, [k / parts for k in range(1, parts)], 0.01)
    for low, high in zip([None, *inner], [*inner, None]):
        span = (F.lit(True) if low is None else C(at) >= low) & (F.lit(True) if high is None else C(at) < high)
        df.where(span).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(df.schema).parquet(source))
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


RESTS = {"up_rest": 7200, "down_rest": 10800}
SCALING = RESTS | {"cpu_up": 99.0, "cpu_down": 60.0}

#: Thresholds of three services, in the form of S11; others aren't scaled.
SERVICES = "click:1:4:99:60:3600, view:2:3:98.5:55:7200, purchase:1:6:97:70:3600"
SCALE_SQL = """WITH {config}, m AS (SELECT service, tick, a, m, low, high, up, down, row_number() OVER (PARTITION BY service ORDER BY tick) AS k FROM (
          SELECT service, (floor(epoch_us(ts) // 1000000 / every) * every)::BIGINT AS tick, avg(cpu) AS a, max(cpu) AS m, any_value(low) AS low, any_value(high) AS high, any_value(up) AS up, any_value(down) AS down
          FROM {{samples}} JOIN config USING (service) GROUP BY 1, 2)),
        z AS (SELECT service, 0::BIGINT AS k, -1000000::BIGINT AS tick, 0 AS action, 1 AS replicas, 0 AS streak, -1000000::BIGINT AS last FROM m WHERE k = 1
          UNION ALL SELECT service, k, tick, action, replicas + action, CASE WHEN action <> 0 THEN 0 ELSE streak END, CASE WHEN action <> 0 THEN tick ELSE last END FROM (
            SELECT *, CASE WHEN streak >= 2 AND tick - last >= 7200 THEN 1 WHEN streak <= -4 AND tick - last >= 10800 THEN -1 ELSE 0 END AS action FROM (
              SELECT m.service, m.k, m.tick, z.replicas, z.last, CASE WHEN (greatest(m.a, 0.95 * m.m) >= m.up OR m.m >= m.up) AND z.replicas < m.high THEN greatest(z.streak, 0) + 1 WHEN m.m <= m.down AND m.a <= m.down AND z.replicas > m.low THEN least(z.streak, 0) - 1 ELSE 0 END AS streak
              FROM z JOIN m ON m.service = z.service AND m.k = z.k + 1)))
        SELECT service, tick, action, replicas FROM z WHERE k > 0"""
SERVICES_SQL = "config AS (SELECT * FROM (VALUES ('click', 1, 4, 99.0, 60.0, 3600), ('view', 2, 3, 98.5, 55.0, 7200), ('purchase', 1, 6, 97.0, 70.0, 3600)) t(service, low, high, up, down, every))"


def scaling_stream(spark, d):
    """T4 from samples to decisions; a sample a year on closes the last windows."""
    samples = view(spark, d, "samples").select("service", C("ts").cast("timestamp").alias("ts"), "cpu")
    closing = samples.groupBy().agg(F.lit("closing").alias("service"), (F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(0.0).alias("cpu"))
    config = load_scale_config(spark, SERVICES)
    every = samples.unionByName(closing).withColumn("at", F.unix_micros("ts") / 1e6)
    return streamed(every, "at", lambda stream: T.stream_scaling(stream, config, **RESTS))

QUERIES = {
    "t1_change_feed": (
        lambda s, d: T.change_feed_fold(feed(s, d)),
        """WITH e AS (SELECT job_id, seq, status, percent FROM (SELECT *, row_number() OVER (PARTITION BY job_id, seq ORDER BY part, supp, price, status, percent) AS k FROM {job_events}) WHERE k = 1),
        a AS (SELECT *, coalesce(max((status IN ('completed', 'error'))::INT) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e)
        SELECT job_id, seq, status, percent FROM (SELECT *, lag(status) OVER w AS s, lag(percent) OVER w AS p, row_number() OVER w AS k FROM a WHERE ended = 0 WINDOW w AS (PARTITION BY job_id ORDER BY seq)) WHERE k = 1 OR status <> s OR percent <> p""",
    ),
    "t2_rate_limit": (
        lambda s, d: T.rate_limit(calls(s, d), 5),
        """WITH c AS (SELECT (user_id % 20)::VARCHAR AS client, event_id, floor(epoch_us(ts) / 1e6 / 1000) AS at0, row_number() OVER (PARTITION BY user_id % 20 ORDER BY floor(epoch_us(ts) / 1e6 / 1000), event_id) AS k FROM {requests}),
        f AS (SELECT client, event_id, k, 4 AS tokens, at0 AS since, true AS allowed FROM c WHERE k = 1
          UNION ALL SELECT c.client, c.event_id, c.k, CASE WHEN c.at0 - f.since >= 60 THEN 4 WHEN f.tokens > 0 THEN f.tokens - 1 ELSE 0 END, CASE WHEN c.at0 - f.since >= 60 THEN c.at0 ELSE f.since END, c.at0 - f.since >= 60 OR f.tokens > 0
          FROM f JOIN c ON c.client = f.client AND c.k = f.k + 1) SELECT client, event_id, allowed FROM f""",
    ),
    "t3_node_health": (lambda s, d: rounded(T.node_health(nodes(s, d)).select("node", "event_id", "ewma", "in_row"), 5), """WITH c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) AS k FROM {requests}),
        f AS (SELECT node, event_id, k, 0.8 * 15::DOUBLE + 0.2 * duration_ms AS ewma, (status_code >= 500)::INT AS in_row FROM c WHERE k = 1
          UNION ALL SELECT c.node, c.event_id, c.k, 0.8 * f.ewma + 0.2 * c.duration_ms, CASE WHEN c.status_code >= 500 THEN f.in_row + 1 ELSE 0 END FROM f JOIN c ON c.node = f.node AND c.k = f.k + 1) SELECT node, event_id, round(ewma, 5) AS ewma, in_row FROM f"""),
    "w4_scale_decisions": (
        lambda s, d: T.scale_decisions(T.interval_metrics(view(s, d, "samples"), 3600), **SCALING),
        """WITH m AS (SELECT service, tick, a, m, row_number() OVER (PARTITION BY service ORDER BY tick) AS k FROM (SELECT service, (floor(epoch_us(ts) // 1000000 / 3600) * 3600)::BIGINT AS tick, avg(cpu) AS a, max(cpu) AS m FROM {samples} GROUP BY 1, 2)),
        z AS (SELECT service, 0::BIGINT AS k, -1000000::BIGINT AS tick, 0 AS action, 1 AS replicas, 0 AS streak, -1000000::BIGINT AS last FROM m WHERE k = 1
          UNION ALL SELECT service, k, tick, action, replicas + action, CASE WHEN action <> 0 THEN 0 ELSE streak END, CASE WHEN action <> 0 THEN tick ELSE last END FROM (
            SELECT *, CASE WHEN streak >= 2 AND tick - last >= 7200 THEN 1 WHEN streak <= -4 AND tick - last >= 10800 THEN -1 ELSE 0 END AS action FROM (
              SELECT m.service, m.k, m.tick, z.replicas, z.last, CASE WHEN (greatest(m.a, 0.95 * m.m) >= 99 OR m.m >= 99) AND z.replicas < 5 THEN greatest(z.streak, 0) + 1 WHEN m.m <= 60 AND m.a <= 60 AND z.replicas > 1 THEN least(z.streak, 0) - 1 ELSE 0 END AS streak
              FROM z JOIN m ON m.service = z.service AND m.k = z.k + 1)))
        SELECT service, tick, action, replicas FROM z WHERE k > 0""",
    ),
    "t5_live_state": (
        lambda s, d: T.live_state(view(s, d, "requests").select("user_id", "ts", "event_id", "path"), F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00")), "user_id").select("user_id", "event_id", "path"),
        "SELECT user_id, event_id, path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {requests}) WHERE k = 1 AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts) < 7200 * 1000000::BIGINT",
    ),
    "t6_idle_sessions": (
        lambda s, d: rounded(T.idle_sessions(view(s, d, "requests").withColumn("duration_ms", C("duration_ms") * 1000), 1800).select("node", F.unix_micros("to").alias("until"), "seconds"), 3),
        """SELECT node, began AS until, round((began - ended) / 1e6, 3) AS seconds FROM (SELECT node, epoch_us(ts) AS began, max(epoch_us(ts) + floor(duration_ms * 1000 * 1000)::BIGINT) OVER (PARTITION BY node ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM {requests})
        WHERE began - ended >= 1800 * 1000000::BIGINT""",
    ),
    "t7_upsert_sessions": (
        lambda s, d: T.upsert_sessions(logins(s, d)).select("token", F.unix_micros(C("expires_at").cast("timestamp")).alias("expires_at"), "agent", "ip", "status"),
        "SELECT 'k' || user_id % 50 AS token, epoch_us(max(ts)) + 3600000000 AS expires_at, arg_max(forwarded, ts) FILTER (forwarded IS NOT NULL) AS agent, arg_max(real_ip, ts) FILTER (real_ip IS NOT NULL) AS ip, 'active' AS status FROM {requests} GROUP BY user_id % 50",
    ),
    "t8_upsert_users": (
        lambda s, d: T.upsert_users(logins(s, d).withColumnRenamed("token", "uid")).select("uid", F.unix_micros(C("created").cast("timestamp")).alias("created"), F.unix_micros(C("last_login").cast("timestamp")).alias("last_login"), "name", "photo"),
        "SELECT 'k' || user_id % 50 AS uid, epoch_us(min(ts)) AS created, epoch_us(max(ts)) AS last_login, arg_max(path, ts) FILTER (event_id % 4 = 0) AS name, arg_max(method, ts) FILTER (event_id % 3 = 0) AS photo FROM {requests} GROUP BY user_id % 50",
    ),
    "t9_dedupe_events": (
        lambda s, d: T.dedupe_events(read(s, d, "events").union(read(s, d, "events"))).groupBy("event_type").agg(F.count("*").alias("n")),
        "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    ),
}
QUERIES["t2_rate_limit_stream"] = (lambda s, d: streamed(calls(s, d), "at", lambda stream: T.stream_rate_limit(stream, 5)), QUERIES["t2_rate_limit"][1])
QUERIES["t4_scale_stream"] = (lambda s, d: streamed(T.interval_metrics(view(s, d, "samples"), 3600), "tick", lambda stream: T.stream_scale_decisions(stream, **SCALING)), QUERIES["w4_scale_decisions"][1])
QUERIES["w4_scale_configured"] = (lambda s, d: T.scale_decisions(T.interval_metrics(view(s, d, "samples"), config=load_scale_config(s, SERVICES)), load_scale_config(s, SERVICES), **RESTS), SCALE_SQL.format(config=SERVICES_SQL))
QUERIES["t4_samples_to_decisions"] = (scaling_stream, QUERIES["w4_scale_configured"][1])
QUERIES["t3_node_health_stream"] = (lambda s, d: rounded(streamed(nodes(s, d), "at", T.stream_node_health).select("node", "event_id", "ewma", "in_row"), 5), QUERIES["t3_node_health"][1])

"""Joins. Prefix, suffix and as-of matches are written as equi-joins or ordered unions, so none is a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import made_since, mark, release, written

from tidemark.functions.predicates import is_valid_session
from tidemark.functions.scalars import cache_keys


def find_cached(requests: DataFrame, files: DataFrame, now: Column, style: str = "gateway", ttl: int = 3600) -> DataFrame:
    """Each request (request_id, url, format, quality) with the first file, by name, that one of its keys begins.

    style gateway takes any size, service wants size > 0, worker wants size > 1024 and knows no age. cached is null without a file."""
    keyed = cache_keys(requests)
    keys = keyed.select("request_id", F.lower("format").alias("format"), F.explode(F.array_distinct(F.array("key_md5", "key_sha", "key_raw"))).alias("key"))
    least = {"gateway": -1, "service": 0, "worker": 1024}[style]
    good = files.where(~F.col("filename").rlike(r"\.(part|ytdl)$") & (F.col("size") > least))
    if style != "worker":
        good = good.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp")) < ttl * 1_000_000)
    good = good.select("filename", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).alias("format"), F.explode(F.array(F.substring("filename", 1, 10), F.substring("filename", 1, 12))).alias("key"))
    hits = keys.join(good, ["key", "format"]).groupBy("request_id").agg(F.min("filename").alias("cached"))
    return requests.join(hits, "request_id", "left")


def expired_files(files: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Files past their age, 1800 s for partial files and those in tmp, else 3600 s, but for files of running jobs; tmp is never protected."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp"))) / 1e6
    brief = F.col("in_tmp") | F.col("filename").rlike(r"\.(part|ytdl|tmp)$")
    old = files.where(age > F.when(brief, 1800).otherwise(3600))
    active = jobs.where(F.col("status").isin("downloading", "queued")).select(F.col("filename").alias("active_name")).distinct()
    return old.join(active, (F.col("filename") == F.col("active_name")) & ~F.col("in_tmp"), "left_anti")


def session_user(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Valid sessions with their user, null if unknown."""
    valid = sessions.where(is_valid_session(F.col("status"), F.col("expires_at"), now))
    return valid.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")


def resolve_identity(tokens: DataFrame, users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tokens (token, uid) with their user, and the session of that token if there is one."""
    known = tokens.join(users.select(F.col("firebase_uid").alias("uid"), F.col("id").alias("user_id")), "uid")
    return known.join(sessions.select(F.col("firebase_token").alias("token"), F.col("id").alias("session_id")), "token", "left")


def containers_with_stats(ps: DataFrame, stats: DataFrame) -> DataFrame:
    """Containers with their processor and memory use, 0 where there is none."""
    return ps.join(stats, "container_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("cpu", "memory_mb")})


def missing_monitors(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted but not there, by url."""
    return desired.join(existing.select("url"), "url", "left_anti")


def match_services(config: DataFrame, services: DataFrame) -> DataFrame:
    """Config (pos, service) with running services (service_id, name, replicas) by name, or by a suffix after an underscore.

    All such suffixes of a name are exploded, so this is an equi-join; the first service by name wins. Services without replicas don't count."""
    parts = F.split("name", "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    ended = services.where(F.col("replicas").isNotNull()).select("service_id", "name", F.explode(F.array_distinct(ends)).alias("service"))
    first = config.join(ended, "service").groupBy("service").agg(F.min(F.struct("name", "service_id")).alias("m"))
    return first.select("service", F.col("m.service_id").alias("service_id"), F.col("m.name").alias("name"))


#: A slice of a medium's time, in seconds.
SLICE = 300.0


def active_segment(times: DataFrame, segments: DataFrame, key: str = "media_id", tail: float = 3.0, seconds: float = SLICE) -> DataFrame:
    """For each time (media_id, t) the segment that plays: the last that has begun, if it hasn't ended.

    Times and segments are one ordered stream, in which each time takes the last segment before it: no range join. The stream of a
    medium is cut into slices of `seconds`; what a slice begins with, and where the last segment of a slice ends, follows
    from one row a slice, so no task sorts a whole medium."""
    cut = lambda c: F.floor(F.col(c) / seconds).alias("slice_")
    here = Window.partitionBy(key, "slice_").orderBy("start", "id")
    rows = segments.select("*", cut("start")).withColumn("next_", F.lead("start").over(here))
    later = Window.partitionBy(key).orderBy("slice_").rowsBetween(1, Window.unboundedFollowing)
    after = rows.groupBy(key, "slice_").agg(F.min("start").alias("f_")).select(key, "slice_", F.min("f_").over(later).alias("after_"))
    spans = rows.join(after, [key, "slice_"]).withColumn("until", F.coalesce("next_", "after_", "end", F.col("start") + tail))
    begun = spans.select(key, F.col("start").alias("t"), F.lit(0).alias("kind"), F.struct("id", "until", "text").alias("seg"))
    asked = times.select(key, "t", F.lit(1).alias("kind"), F.lit(None).cast(begun.schema["seg"].dataType).alias("seg"))
    both = begun.unionByName(asked).withColumn("slice_", cut("t"))
    last = both.groupBy(key, "slice_").agg(F.max(F.when(F.col("kind") == 0, F.struct("t", F.col("seg.id").alias("id"), "seg"))).alias("last_"))
    earlier = Window.partitionBy(key).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(key, "slice_", F.last(F.col("last_.seg"), True).over(earlier).alias("before_"))
    order = Window.partitionBy(key, "slice_").orderBy("t", "kind", F.col("seg.id"))
    met = both.withColumn("own_", F.last("seg", True).over(order)).where("kind = 1").join(before, [key, "slice_"])
    met = met.withColumn("now", F.coalesce("own_", "before_"))
    plays = F.col("t") < F.col("now.until")
    return met.select(key, "t", F.when(plays, F.col("now.id")).alias("id"), F.when(plays, F.col("now.text")).alias("text"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Spans with their depth below the root; null where no root is found.

    By pointer doubling: each span points to its parent, one level up; a round replaces a pointer by that of the span it points to
    and adds their lengths, so a tree of any depth takes the logarithm of its depth in rounds, each a join of written
    tables. Spans whose pointers meet nothing have no root; when a round ends no pointer, what is left are circles.

    Of an id that stands more than once in a trace, a root counts first, then the smallest parent."""
    spark, key = spans.sparkSession, ["trace_id", "span_id"]
    parent = F.min(F.struct(F.col("parent_span_id").isNotNull().alias("below"), F.col("parent_span_id").alias("up"))).alias("p")
    first = spans.groupBy(*key).agg(parent).select(*key, "p.up", F.when(F.col("p.up").isNull(), 0).otherwise(1).alias("depth"))
    state = written(first, "span-pointers")
    left = None
    while (n := state.where("up IS NOT NULL").count()) and n != left:
        left = n
        place = mark() - 1
        above = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up_"), F.col("depth").alias("depth_"))
        # up is null at the root, and where no such span is (the depth then is null as well)
        met = state.where("up IS NOT NULL").join(above, ["trace_id", "up"], "left").select(*key, F.col("up_").alias("up"), (F.col("depth") + F.col("depth_")).alias("depth"))
        state = written(state.where("up IS NULL").unionByName(met), "span-pointers")
        release(spark, made_since(place, but_last=True))
    found = state.select(*key, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    return spans.join(found, key, "left")

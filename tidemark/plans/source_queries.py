"""Queries of the readers and writers: rows of the tables are written in a source's format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import containers_with_stats
from tidemark.sources import readers as R
from tidemark.staging import folder

from .standins import view
from .table_queries import read, rounded

C = F.col
#: Files of a kind that a query writes.
FILES = 16


def text_file(df: DataFrame, value, label: str) -> str:
    path = folder(df.sparkSession, label)
    df.select(value.alias("value")).write.text(path)
    return path


def grouped(df: DataFrame, value, group, label: str, order: list[str] = ()) -> str:
    """A folder group=K with one file for each of few groups, in order."""
    path = folder(df.sparkSession, label)
    rows = df.withColumn("group", group).repartition("group").sortWithinPartitions("group", *order).select(value.alias("value"), "group")
    rows.write.partitionBy("group").text(path)
    return path


def group_of(column: str):
    return F.regexp_extract(column, r"group=(\d+)", 1).cast("int")


def job_events(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "job_events").select("job_id", "status", C("percent").cast("double").alias("percent"), "error")
    line = F.to_json(F.struct("job_id", "status", "percent", "error"))
    # a blank line and a broken one after some
    lines = rows.select(F.explode(F.when(C("percent") % 10 == 0, F.array(line, F.lit(""), F.lit("{broken"))).otherwise(F.array(line))).alias("line"))
    return R.read_job_events(spark, text_file(lines, C("line"), "source-events")).select("job_id", "status", "percent", "error")


def spans(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "spans").select(
        C("trace_id").cast("string").alias("trace_id"), C("span_id").cast("string").alias("span_id"), C("parent_span_id").cast("string").alias("parent_span_id"), F.concat(F.lit("span "), C("span_id") % 5).alias("name"), F.concat(F.lit("svc"), C("trace_id") % 3).alias("service"),
        (C("span_id") * 1000).alias("start_nanos"), (C("span_id") * 1000 + 7).alias("end_nanos"), (C("span_id") % 3).cast("int").alias("status"), F.create_map(F.lit("n"), (C("span_id") % 10).cast("string")).alias("attrs"),
    )
    path = folder(spark, "source-spans")
    R.write_spans(rows, path)
    return R.read_spans(spark, path).select("trace_id", "span_id", "parent_span_id", "name", "service", "start_nanos", "end_nanos", "status", C("attrs")["n"].alias("n"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, numbered from 1 in each of FILES groups."""
    rows = read(spark, d, "conversations").select((C("conv_id") % FILES).cast("int").alias("media_id"), "conv_id", "turn", "text")
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("media_id").orderBy("conv_id", "turn")))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    part = F.struct(F.struct((C("id") * 1234).alias("from"), (C("id") * 1234 + 900).alias("to")).alias("offsets"), F.when(C("turn") % 3 == 2, F.lit(" ")).otherwise(F.concat(F.lit(" turn "), C("turn"), F.lit(" "))).alias("text"), F.lit(-0.5).alias("logprob"))
    files = turns(spark, d).groupBy("media_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", part.alias("s")))), lambda x: x["s"]).alias("transcription"))
    path = grouped(files, F.to_json(F.struct("transcription")), C("media_id"), "source-transcripts")
    return R.read_transcripts(spark, path).select(group_of("media_id").alias("media_id"), "id", "start", "end", "text", "avg_logprob")


def subtitles(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    rows = turns(spark, d).select("media_id", "id", (C("id") * 2.5).cast("double").alias("start"), (C("id") * 2.5 + 1.25).cast("double").alias("end"), F.concat(F.lit("turn "), C("turn"), F.lit("\nof "), "conv_id").alias("text"))
    path = folder(spark, "source-subtitles")
    R.write_subtitles(rows, path, fmt)
    return R.read_subtitles(spark, path).select(F.regexp_extract("media_id", r"media_id=(\d+)", 1).cast("int").alias("media_id"), "id", "start", "end", "text")


def findings(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings").select("tool", "severity", "path", C("line").cast("int").alias("line"), "doc_id")
    line = F.when(C("doc_id") % 10 == 9, F.lit("no finding")).otherwise(F.to_json(F.struct("tool", "severity", "path", "line")))
    return R.read_findings(spark, grouped(rows, line, C("doc_id") % FILES, "source-findings")).select("tool", "severity", "path", "line")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    card = lambda k: F.struct(F.lit(k).alias("gpuIndex"), C("p_size").cast("double").alias("utilizationPercent"), C("p_retailprice").alias("memoryUsedMb"), F.lit(9999.0).alias("memoryTotalMb"))
    stats = F.struct(C("p_size").cast("double").alias("cpu"), C("p_retailprice").alias("memory"), F.array(F.lit(1.0), C("p_size").cast("double")).alias("cores"))
    one = F.struct(F.concat(F.lit("h"), "p_partkey").alias("hostId"), stats.alias("hostStats"), F.when(C("p_partkey") % 3 == 0, F.array(card(0), card(1))).when(C("p_partkey") % 3 == 1, F.array(card(0))).alias("gpu"))
    files = p.groupBy((C("p_partkey") % FILES).alias("g")).agg(F.to_json(F.collect_list(one)).alias("v"))
    found = R.read_host_snapshots(spark, grouped(files, C("v"), C("g"), "source-hosts"))
    cores = found["cores"].groupBy("host").agg(F.sum("load").alias("load"))
    return found["hosts"].join(found["gpu"], "host", "left").join(cores, "host").select("host", "cpu", "memory", "load", "gpuIndex", "utilizationPercent", "memoryUsedMb")


def containers(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("id", F.concat(F.lit("c"), "p_partkey"))
    ps = F.when(C("p_partkey") % 11 == 0, F.concat_ws("|", "id", F.lit("short"))).otherwise(F.concat_ws("|", "id", "p_name", "p_brand", F.lit("Up")))
    unit = F.element_at(F.array(*map(F.lit, ("GiB", "MiB", "kB"))), (C("p_partkey") % 3 + 1).cast("int"))
    use = F.concat(C("id"), F.lit("|"), C("p_size").cast("string"), F.lit(".5%|"), C("p_size").cast("string"), unit, F.lit(" / 8GiB"))
    rows = R.read_container_stats(spark, text_file(p, ps, "source-ps"), text_file(p.where("p_partkey % 5 > 0"), use, "source-stats"))
    return rounded(containers_with_stats(*rows).select("container_id", "name", "cpu", "memory_mb"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", C("event_id").cast("string")).alias("line"))
    return R.read_log_lines(spark, grouped(rows, C("line"), C("event_id") % FILES, "source-logs", ["event_id"])).select(group_of("file").alias("file"), C("pos").cast("long").alias("pos"), "line")


def job_state(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "source-state")
    R.write_job_state(read(spark, d, "events").select(C("user_id").alias("job_id"), "ts"), path)
    micros = lambda c: F.unix_micros(C(c).cast("timestamp")).alias(c)
    return spark.read.parquet(path).select("job_id", micros("ts"), micros("expires_at"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "source-metadata")
    R.write_metadata(read(spark, d, "events").groupBy(C("user_id").alias("key")).agg(F.max("ts").alias("ts")).withColumn("ttl_seconds", F.when(C("key") % 2 == 0, C("key") % 100 + 1)), path)
    return spark.read.parquet(path).select("key", ((F.unix_micros(C("expires_at").cast("timestamp")) - F.unix_micros(C("ts").cast("timestamp"))) / 1_000_000).cast("long").alias("lives"))


TURNS = f"(SELECT (conv_id % {FILES})::INT AS media_id, conv_id, turn, row_number() OVER (PARTITION BY conv_id % {FILES} ORDER BY conv_id, turn)::INT AS id FROM conversations)"
SUBTITLES = f"SELECT media_id, id, id * 2.5::DOUBLE AS start, id * 2.5::DOUBLE + 1.25 AS \"end\", 'turn ' || turn || chr(10) || 'of ' || conv_id AS text FROM {TURNS}"

def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of one file for each kind, and what a scan of the files tells of their sizes."""
    rows = read(spark, d, "events")
    path = grouped(rows, F.concat(C("event_type"), F.lit(" "), C("event_id")), C("user_id") % FILES, "source-artifacts")
    found = R.scan_artifacts(spark, path).where(C("filename").endswith(".txt"))
    return found.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("partial").alias("partial"))


def scale_config(spark: SparkSession, d: str) -> DataFrame:
    """A service for each nation: some fields are missing or unreadable, blanks stand around, and one name comes twice."""
    fields = F.concat(F.lit(" "), C("n_name"), F.when(C("n_nationkey") % 4 > 0, F.concat(F.lit(":"), C("n_regionkey"), F.lit(":"), F.when(C("n_nationkey") % 3 == 0, "many").otherwise(C("n_nationkey").cast("string")))).otherwise(""), F.when(C("n_nationkey") % 8 == 1, F.concat(F.lit(":77.5:"), C("n_nationkey"), F.lit(":0"))).otherwise(""))
    text = read(spark, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", fields.alias("f")))), lambda x: x["f"]), ",")).first()[0]
    again = text.split(",")[3].strip().split(":")[0]
    return R.load_scale_config(spark, f"{text},{again}:9:9").select("service", "min_replicas", "max_replicas", "cpu_up", "cpu_down", "interval_sec")


QUERIES = {
    "s1_job_events": (job_events, "SELECT job_id, status, percent::DOUBLE AS percent, error FROM {job_events}"),
    "s3_spans_round_trip": (
        spans,
        "SELECT trace_id::VARCHAR AS trace_id, span_id::VARCHAR AS span_id, parent_span_id::VARCHAR AS parent_span_id, 'span ' || span_id % 5 AS name, 'svc' || trace_id % 3 AS service, span_id * 1000 AS start_nanos, span_id * 1000 + 7 AS end_nanos, (span_id % 3)::INT AS status, (span_id % 10)::VARCHAR AS n FROM {spans}",
    ),
    "s5_transcripts": (
        lambda s, d: rounded(transcripts(s, d), 3),
        f"SELECT media_id, id, round(id * 1.234::DOUBLE, 3) AS start, round(id * 1.234::DOUBLE + 0.9, 3) AS \"end\", 'turn ' || turn AS text, -0.5::DOUBLE AS avg_logprob FROM {TURNS} WHERE turn % 3 <> 2",
    ),
    "s6_subtitles_srt": (lambda s, d: subtitles(s, d, "srt"), SUBTITLES),
    "s7_subtitles_vtt": (lambda s, d: subtitles(s, d, "vtt"), SUBTITLES),
    "s4_artifacts": (artifacts, f"SELECT count(DISTINCT user_id % {FILES}) AS files, sum(strlen(event_type || ' ' || event_id) + 1)::BIGINT AS bytes, 0::BIGINT AS partial FROM events"),
    "s11_scale_config": (
        scale_config,
        """SELECT n_name AS service, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey ELSE 1 END::INT AS min_replicas, CASE WHEN n_nationkey % 4 > 0 AND n_nationkey % 3 > 0 THEN n_nationkey ELSE 5 END::INT AS max_replicas,
        CASE WHEN n_nationkey % 8 = 1 THEN 77.5 ELSE 65 END::DOUBLE AS cpu_up, CASE WHEN n_nationkey % 8 = 1 THEN n_nationkey ELSE 20 END::DOUBLE AS cpu_down, 8::INT AS interval_sec FROM nation""",
    ),
    "s8_findings": (findings, "SELECT tool, severity, path, line::INT AS line FROM {findings} WHERE doc_id % 10 <> 9"),
    "s9_host_snapshots": (
        snapshots,
        "SELECT 'h' || p_partkey AS host, p_size::DOUBLE AS cpu, p_retailprice AS memory, 1.0::DOUBLE + p_size AS load, g AS \"gpuIndex\", CASE WHEN g IS NOT NULL THEN p_size::DOUBLE END AS \"utilizationPercent\", CASE WHEN g IS NOT NULL THEN p_retailprice END AS \"memoryUsedMb\" FROM (SELECT *, unnest(CASE p_partkey % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] ELSE [NULL] END) AS g FROM part)",
    ),
    "s10_container_stats": (
        containers,
        "SELECT 'c' || p_partkey AS container_id, p_name AS name, CASE WHEN p_partkey % 5 > 0 THEN p_size + 0.5 ELSE 0 END::DOUBLE AS cpu, round(CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN p_size * 1024 WHEN p_partkey % 3 = 1 THEN p_size ELSE p_size / 1024.0::DOUBLE END::DOUBLE, 6) AS memory_mb FROM part WHERE p_partkey % 11 > 0",
    ),
    "s13_log_lines": (
        log_lines,
        f"SELECT (event_id % {FILES})::INT AS file, row_number() OVER (PARTITION BY event_id % {FILES} ORDER BY event_id) - 1 AS pos, event_type || ' ' || event_id AS line FROM events UNION ALL SELECT (event_id % {FILES})::INT, count(*), '' FROM events GROUP BY 1",
    ),
    "s14_job_state": (job_state, "SELECT user_id AS job_id, epoch_us(max(ts)) AS ts, epoch_us(max(ts)) + 7200000000 AS expires_at FROM events GROUP BY 1"),
    "s14_metadata": (metadata, "SELECT user_id AS key, CASE WHEN user_id % 2 = 0 THEN user_id % 100 + 1 ELSE 3600 END::BIGINT AS lives FROM events GROUP BY 1"),
}

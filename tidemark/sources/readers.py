"""Readers and writers. Every source has a fixed schema; the executors list, read and parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import format_ts, parse_ts, round_half_away
from tidemark.operators.windows import latest_state

from .changes import read_changes, upsert_batch

#: Pixels that are turned into rows at once.
PIXELS = 1 << 18

JOB_EVENT = "job_id string, ts timestamp, status string, percent double, speed string, eta string, filename string, download_url string, error string"
VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},status:struct<code:int>>"
SPANS = f"resourceSpans array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{SPAN}>>>>>"
TRANSCRIPT = "transcription array<struct<offsets:struct<from:bigint,to:bigint>,text:string,avg_logprob:double,logprob:double>>"
FINDING = "tool string, rule string, severity string, path string, line int, secret string, message string"
DEVICE = "struct<name:string,read:bigint,written:bigint>"
HOST = (
    "hostId string, hostStats struct<cpu:double,memory:double,load:array<double>,network:struct<rx:bigint,tx:bigint>,cores:array<double>,topProcesses:array<struct<pid:int,name:string,cpu:double>>>, "
    "containers array<struct<id:string,name:string,cpu:double,memory_mb:double>>, gpu array<struct<gpuIndex:int,utilizationPercent:double,memoryUsedMb:double,memoryTotalMb:double,temperatureC:double>>"
)


def read_job_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One JSON event a line; blank and malformed lines are dropped."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(JOB_EVENT).option("mode", "DROPMALFORMED").json(path)
    return rows.where("status IS NOT NULL OR job_id IS NOT NULL")


def attribute_map(attributes: Column) -> Column:
    """Typed values as text, by key."""
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.map_from_entries(F.transform(F.coalesce(attributes, F.array().cast(ATTRIBUTES)), lambda a: F.struct(a["key"], value(a["value"]))))


def read_spans(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Nested trace exports, one a line (multiline: one a file), as one row a span."""
    rows = spark.read.schema(SPANS).option("multiLine", multiline).json(path).select(F.explode("resourceSpans").alias("r"))
    rows = rows.select(attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s"))
    rows = rows.select("resource", F.explode("s.spans").alias("x"))
    return rows.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("x.name").alias("name"),
        F.try_element_at("resource", F.lit("service.name")).alias("service"), F.col("x.startTimeUnixNano").cast("long").alias("start_nanos"), F.col("x.endTimeUnixNano").cast("long").alias("end_nanos"),
        F.col("x.status.code").alias("status"), attribute_map(F.col("x.attributes")).alias("attrs"),
    )


def write_spans(spans: DataFrame, path: str, batch: int = 1000) -> None:
    """S3: the inverse of read_spans; a line of JSON holds one service's spans, some `batch` of them at most on average."""
    texts = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    one = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), "name", F.lit(1).alias("kind"),
        F.col("start_nanos").cast("string").alias("startTimeUnixNano"), F.col("end_nanos").cast("string").alias("endTimeUnixNano"), texts(F.col("attrs")).alias("attributes"), F.struct(F.col("status").alias("code")).alias("status"),
    )
    sizes = spans.groupBy(F.col("service").alias("of")).agg(F.ceil(F.count("*") / batch).alias("parts"))
    parts = spans.join(sizes, F.col("service").eqNullSafe(F.col("of"))).select("service", F.pmod(F.xxhash64("trace_id", "span_id"), "parts").alias("part"), one.alias("span"))
    grouped = parts.groupBy("service", "part").agg(F.collect_list("span").alias("spans"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))).alias("attributes"))
    body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))
    grouped.select(F.to_json(body).alias("value")).write.mode("overwrite").text(path)


def scan_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files with name, size and time; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), name.rlike(r"\.(part|ytdl|tmp)$").alias("partial"), F.col("path").contains("/tmp/").alias("in_tmp"))


def read_transcripts(spark: SparkSession, path: str, decimals: int = 3) -> DataFrame:
    """A row a segment; ids are places in the array, which blank segments use up."""
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("media_id"), F.posexplode("transcription").alias("pos", "s"))
    time = lambda c: round_half_away(F.col(c) / 1000.0, decimals)
    rows = rows.select("media_id", (F.col("pos") + 1).alias("id"), time("s.offsets.from").alias("start"), time("s.offsets.to").alias("end"), F.trim("s.text").alias("text"), F.coalesce(F.nullif("s.avg_logprob", F.lit(0.0)), "s.logprob").alias("avg_logprob"))
    return rows.where("text <> ''")


TIME_LINE = r"^\s*([0-9:.,]+)\s*-->\s*([0-9:.,]+)"


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT or VTT files. A time line opens a cue, text lines join it, a blank line closes it; a cue that
    another time line interrupts is lost; numbers outside cues are skipped."""
    lines = numbered_lines(spark, path, "media_id").withColumn("line", F.regexp_replace("line", "\r", ""))
    w = Window.partitionBy("media_id").orderBy("pos")
    lines = lines.withColumn("line", F.trim("line")).withColumn("opens", F.col("line").rlike(TIME_LINE))
    lines = lines.withColumn("cue", F.sum(F.col("opens").cast("int")).over(w)).where("cue > 0")
    inside = Window.partitionBy("media_id", "cue").orderBy("pos")
    lines = lines.withColumn("blanks", F.sum((F.col("line") == "").cast("int")).over(inside)).withColumn("last", F.max("cue").over(Window.partitionBy("media_id")))
    words = F.transform(F.sort_array(F.collect_list(F.when((F.col("blanks") == 0) & ~F.col("opens"), F.struct("pos", "line")))), lambda x: x["line"])
    head = F.max(F.when(F.col("opens"), F.col("line")))
    cues = lines.groupBy("media_id", "cue", "last").agg(head.alias("head"), words.alias("words"), F.max("blanks").alias("blanks"))
    cues = cues.where("(blanks > 0 OR cue = last) AND size(words) > 0")
    time = lambda k: round_half_away(parse_ts(F.regexp_extract("head", TIME_LINE, k)), 2)
    id_ = F.row_number().over(Window.partitionBy("media_id").orderBy("cue"))
    return cues.select("media_id", id_.alias("id"), time(1).alias("start"), time(2).alias("end"), F.array_join("words", "\n").alias("text"))


def subtitle_text(segments: DataFrame, fmt: str, style: str = "worker") -> DataFrame:
    """(media_id, value): each medium's segments as txt, srt, vtt or json. style: worker, gateway or client."""
    mark = "vtt" if fmt == "vtt" else "srt"
    times = F.concat(format_ts(F.col("start"), mark), F.lit(" --> "), format_ts(F.col("end"), mark))
    numbered = fmt == "srt" or style == "client"
    cue = {
        "txt": F.col("text"),
        "srt": F.concat(F.col("id").cast("string"), F.lit("\n"), times, F.lit("\n"), F.col("text")),
        "vtt": F.concat(F.concat(F.col("id").cast("string"), F.lit("\n")) if numbered else F.lit(""), times, F.lit("\n"), F.col("text")),
        "json": F.to_json(F.struct("id", "start", "end", "text")),
    }[fmt]
    sep = {"txt": {"gateway": " ", "worker": "\n", "client": "\n\n"}[style], "json": ","}.get(fmt, "\n\n")
    ordered = F.sort_array(F.collect_list(F.struct("id", cue.alias("cue"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["cue"]), sep)
    whole = {"vtt": F.concat(F.lit("WEBVTT\n\n"), joined), "json": F.concat(F.lit("["), joined, F.lit("]"))}.get(fmt, joined)
    return segments.groupBy("media_id").agg(whole.alias("value"))


def write_subtitles(segments: DataFrame, path: str, fmt: str, style: str = "worker") -> None:
    """One folder for each medium."""
    subtitle_text(segments, fmt, style).write.mode("overwrite").partitionBy("media_id").text(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """A file is an array, an object, or an object a line; what isn't JSON is skipped."""
    rows = spark.read.text(path, wholetext=True)
    many, one = f"array<struct<{FINDING.replace(' string', ':string').replace(' int', ':int')}>>", FINDING
    array = F.when(F.trim("value").startswith("["), F.from_json("value", many))
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, one))
    whole = F.from_json("value", one)
    single = F.when(F.trim("value").startswith("{") & (F.size(lines) == 1) & whole.isNotNull(), F.array(whole))
    found = rows.select(F.explode(F.coalesce(array, single, lines)).alias("f")).where("f IS NOT NULL").select("f.*")
    return found.where(F.coalesce(*[F.col(c).cast("string") for c in found.columns]).isNotNull())


def read_host_snapshots(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Hosts, and what they list: containers, cores, processes and graphics cards (gpu)."""
    rows = spark.read.schema(HOST).option("multiLine", True).json(path)
    host = rows.select(F.col("hostId").alias("host"), "hostStats.cpu", "hostStats.memory", F.col("hostStats.network.rx").alias("rx"), F.col("hostStats.network.tx").alias("tx"))
    listed = lambda c: rows.select(F.col("hostId").alias("host"), F.explode(c).alias("x")).select("host", "x.*")
    return {"hosts": host, "containers": listed("containers"), "processes": listed("hostStats.topProcesses"), "gpu": listed("gpu"), "cores": rows.select(F.col("hostId").alias("host"), F.posexplode("hostStats.cores").alias("core", "load"))}


def memory_mb(text: Column) -> Column:
    """A size with unit in MB."""
    number = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"[0-9.]+\s*([A-Za-z]+)", 1))
    return F.when(unit == "gib", number * 1024).when(unit == "mib", number).when(unit.isin("kb", "kib"), number / 1024).when(unit == "b", number / 1024 / 1024)


def read_container_stats(spark: SparkSession, ps_path: str, stats_path: str) -> tuple[DataFrame, DataFrame]:
    """Containers (id|name|image|status) and their use (id|cpu%|used / limit); short rows are dropped."""
    ps = spark.read.schema("container_id string, name string, image string, status string").option("sep", "|").csv(ps_path).where("status IS NOT NULL")
    stats = spark.read.schema("container_id string, cpu string, memory string").option("sep", "|").csv(stats_path).where("memory IS NOT NULL")
    used = F.get(F.split("memory", "/"), F.lit(0))
    return ps, stats.select("container_id", F.coalesce(F.regexp_replace("cpu", "%", "").try_cast("double"), F.lit(0.0)).alias("cpu"), F.coalesce(memory_mb(used), F.lit(0.0)).alias("memory_mb"))


def load_scale_config(spark: SparkSession, text: str) -> DataFrame:
    """Name:min:max:up:down:interval, ...; a missing or unreadable field has its default; the first of a name wins."""
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("pos", "item")).withColumn("p", F.split(F.trim("item"), ":"))
    part = lambda k, kind, default: F.coalesce(F.get("p", F.lit(k)).try_cast(kind), F.lit(default).cast(kind))
    interval = part(5, "int", 8)
    rows = rows.select("pos", F.trim(F.get("p", F.lit(0))).alias("service"), part(1, "int", 1).alias("min_replicas"), part(2, "int", 5).alias("max_replicas"), part(3, "double", 65.0).alias("cpu_up"), part(4, "double", 20.0).alias("cpu_down"), F.when(interval > 0, interval).otherwise(8).alias("interval_sec"))
    first = rows.where("service <> ''").groupBy("service").agg(F.min_by(F.struct("min_replicas", "max_replicas", "cpu_up", "cpu_down", "interval_sec", "pos"), "pos").alias("c"))
    return first.select("service", "c.*")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Images as pixel rows (image_id, x, y, r, g, b, a). The image source gives bytes in the order blue, green, red, alpha; an
    image's bytes become rows in numpy, some hundred thousand at once. What can't be read is left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.nChannels", "image.data")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, width, n, data in zip(*(batch.column(c) for c in ("origin", "width", "nChannels", "data"))):
                flat = np.frombuffer(data.as_py(), np.uint8).reshape(-1, n.as_py()).astype(np.int32)
                for i in range(0, len(flat), PIXELS):
                    part = flat[i : i + PIXELS]
                    at = np.arange(i, i + len(part))
                    blue, green, red = (part[:, min(c, n.as_py() - 1)] for c in range(3))
                    alpha = part[:, 3] if n.as_py() == 4 else np.full(len(part), 255, np.int32)
                    columns = [pa.array([origin.as_py()] * len(part)), *(pa.array(c.astype(np.int32)) for c in (at % width.as_py(), at // width.as_py(), red, green, blue, alpha))]
                    yield pa.RecordBatch.from_arrays(columns, names=["image_id", "x", "y", "r", "g", "b", "a"])

    return rows.mapInArrow(pixels, "image_id string, x int, y int, r int, g int, b int, a int")


def read_grid_sizes(spark: SparkSession, path: str) -> DataFrame:
    """The grid sizes that users gave (image_id, cols, rows), from CSV with a header; sizes under 1 are left out, and the last of an
    image by line wins."""
    rows = spark.read.schema("image_id string, cols int, rows int").option("header", True).csv(path).where("cols >= 1 AND rows >= 1")
    placed = rows.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("line_"))
    return placed.groupBy("image_id").agg(F.max_by(F.struct("cols", "rows"), F.struct("file_", "block_", "line_")).alias("s_")).select("image_id", "s_.*")


def numbered_lines(spark: SparkSession, path: str, name: str = "file") -> DataFrame:
    """(name, pos, line): the lines of text files, numbered from 0 within each, the empty one after a last newline included.

    Spark splits files into byte ranges, however large they are, and each range's lines are counted; a line's number is its place in
    its range and the lines of the ranges before, which are a row each. A file without a byte has no lines."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(name), F.col("_metadata.file_block_start").alias("block_"), F.col("_metadata.file_size").alias("size_"), F.monotonically_increasing_id().alias("id_"), F.col("value").alias("line")
    )
    blocks = rows.groupBy(name, "block_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_"), F.sum(F.octet_length("line") + 1).alias("bytes_"), F.max("size_").alias("size_"))
    w = Window.partitionBy(name).orderBy("block_")
    before = blocks.select(name, "block_", "first_", F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    lines = rows.join(before, [name, "block_"]).select(name, (F.col("before_") + F.col("id_") - F.col("first_")).cast("int").alias("pos"), "line")
    ends = blocks.groupBy(name).agg(F.sum("n_").cast("int").alias("pos"), F.sum("bytes_").alias("bytes_"), F.max("size_").alias("size_"))
    return lines.unionByName(ends.where("bytes_ = size_").select(name, "pos", F.lit("").alias("line")))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and their number in it."""
    return numbered_lines(spark, path)


def write_job_state(events: DataFrame, path: str, ttl: int = 7200) -> None:
    """Each job's latest state with the time at which it ends."""
    state = latest_state(events, "job_id", ["ts"])
    state.withColumn("expires_at", F.col("ts") + F.make_dt_interval(secs=F.lit(ttl))).write.mode("overwrite").parquet(path)


def write_metadata(rows: DataFrame, path: str, key: str = "key", ttl: int = 3600) -> None:
    """The latest metadata of each key (with ts, and ttl_seconds where a row has a lifetime of its own) with the time at which it ends."""
    own = F.coalesce("ttl_seconds", F.lit(ttl)) if "ttl_seconds" in rows.columns else F.lit(ttl)
    latest_state(rows, key, ["ts"]).withColumn("expires_at", F.col("ts") + F.make_dt_interval(secs=own)).write.mode("overwrite").parquet(path)


def newest_state(rows: DataFrame) -> DataFrame:
    """The latest row of each job, of equally late ones that of the later batch."""
    return latest_state(rows, "job_id", ["ts", "order_"]).drop("order_")


def stream_job_state(events: DataFrame, path: str, ttl: int = 7200):
    """S14 on a stream: a writer that adds each batch's latest states to the table of changes at path; read it with
    read_job_state. Start it with a checkpoint; a batch that is done twice changes nothing the second time."""

    def ended(df: DataFrame) -> DataFrame:
        return latest_state(df, "job_id", ["ts"]).withColumn("expires_at", F.col("ts") + F.make_dt_interval(secs=F.lit(ttl)))

    return events.writeStream.foreachBatch(lambda batch, number: upsert_batch(ended(batch), path, number, newest_state))


def read_job_state(spark: SparkSession, path: str) -> DataFrame:
    """The table that stream_job_state writes."""
    return read_changes(spark, path, newest_state)

"""Scalar expressions over URLs, names, times, spans and progress: native columns throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types and words that results must name as they are.
MIME_TYPES = {
    ".mp4": "video/mp4", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp",
    ".txt": "text/plain; charset=utf-8", ".srt": "text/plain; charset=utf-8", ".vtt": "text/vtt; charset=utf-8", ".json": "application/json",
}
FONTS = ("times new roman", "arial", "calibri", "cambria", "georgia", "courier new", "consolas", "tahoma", "verdana", "trebuchet ms", "segoe ui", "helvetica", "garamond", "palatino linotype", "roboto", "open sans")
#: Words in an error, by category, in order of precedence.
ERROR_WORDS = (
    ("login", ("login", "sign in")),
    ("unparsable", ("cannot parse data", "400")),
    ("private", ("private video", "this video is private", "join this group")),
    ("unavailable", ("video unavailable", "this video is unavailable", "not available")),
    ("unsupported", ("unsupported url",)),
    ("region", ("geo", "country")),
    ("timeout", ("timed out", "timeout")),
)


def round_half_away(x: Column, places: int = 0) -> Column:
    """half away from zero on the scaled double, so 1.005 gives 1.0 at two places."""
    scale = F.lit(float(10**places))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def round_half_even(x: Column, places: int = 0) -> Column:
    """ties to the even neighbour."""
    return F.bround(x, places)


def clean_url(url: Column, style: str = "worker") -> Column:
    """one spelling for a video; other URLs lose tracking parameters and fragment (worker) or stay, trimmed (gateway)."""
    u = F.trim(url)
    host, query, path = (F.try_parse_url(u, F.lit(p)) for p in ("HOST", "QUERY", "PATH"))
    video = F.nullif(F.regexp_extract(F.concat(F.lit("&"), F.coalesce(query, F.lit(""))), "[&]v=([^&]+)", 1), F.lit(""))
    short = F.nullif(F.regexp_replace(path, "^/+|/+$" if style == "worker" else "^/", ""), F.lit(""))
    youtube = F.coalesce(host.contains("youtube.com") | host.contains("youtu.be"), F.lit(False))
    found = F.coalesce(video, F.when(host.contains("youtu.be"), short))
    if style == "gateway":
        rest = u
    else:
        kept = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.rlike("^[^=]+=.") & ~p.rlike("^(fbclid|utm_)") & ~p.startswith("mibextid="))
        tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
        rest = F.when(host.isNull(), u).otherwise(F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(u, F.lit("AUTHORITY")), F.coalesce(path, F.lit("")), tail))
    return F.when(youtube & found.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), found)).otherwise(rest)


def cache_keys(df: DataFrame) -> DataFrame:
    """key_md5, key_sha and key_raw of (url, format, quality)."""
    end = F.concat(F.lit("_"), F.lower("format"), F.lit("_"), F.col("quality"))
    clean = F.concat(clean_url(F.col("url"), "gateway"), end)
    return df.withColumns({
        "key_md5": F.substring(F.md5(clean), 1, 10),
        "key_sha": F.substring(F.sha2(clean, 256), 1, 10),
        "key_raw": F.substring(F.sha2(F.concat(F.trim("url"), end), 256), 1, 12),
    })


def content_key(content: Column) -> Column:
    """the key of a file's content, or of a parameter string."""
    return F.substring(F.sha2(content, 256), 1, 16)


def sanitize_name(name: Column, style: str = "media") -> Column:
    """media strips forbidden signs and cuts at 120; document, image and pixel keep ASCII names; upscale drops the rest."""
    if style == "media":
        out, word = F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/*?:"<>|]', ""), r"\s+", " ")), 1, 120), "download"
    elif style == "document":
        out, word = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_.-]", "_"), r"^[._\- ]+|[._\- ]+$", ""), "document"
    elif style == "image":
        out, word = F.regexp_replace(name, r"[^a-zA-Z0-9_\-.]", "_"), "image"
    elif style == "pixel":
        out, word = F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), "image"
    else:
        out, word = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", ""), "image"
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(word))


def display_filename(name: Column) -> Column:
    """what follows the first underscore; control signs, quotes and backslashes become underscores."""
    rest = F.when(name.contains("_"), F.regexp_replace(name, r"^[^_]*_", "")).otherwise(name)
    return F.regexp_replace(rest, r'[\x00-\x1F\x7F"\\]', "_")


def mime_type(ext: Column) -> Column:
    """by extension with its dot, in any case."""
    pairs = [F.lit(x) for pair in MIME_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(ext)), F.lit("application/octet-stream"))


def format_bytes(size: Column, style: str = "gateway") -> Column:
    """gateway writes one decimal up to EB; client drops a zero decimal and stops at GB."""
    n = size.cast("double")
    if style == "gateway":
        out = F.when(size < 1024, F.format_string("%d B", size))
        for k, unit in enumerate("KMGTP", 1):
            out = out.when(size < 1024 ** (k + 1), F.format_string(f"%.1f {unit}B", n / 1024.0**k))
        return out.otherwise(F.format_string("%.1f EB", n / 1024.0**6))
    trimmed = lambda k, unit: F.concat(F.regexp_replace(F.format_string("%.1f", n / 1024.0**k), r"\.0$", ""), F.lit(f" {unit}"))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").when(size < 1024, trimmed(0, "B")).when(size < 1024**2, trimmed(1, "KB")).when(size < 1024**3, trimmed(2, "MB")).otherwise(trimmed(3, "GB"))


def format_duration(seconds: Column, style: str = "media") -> Column:
    """F8: media H:MM:SS or M:SS (whole seconds); clock MM:SS; human Xm Ys or Xs (rounded)."""
    whole = F.floor(seconds).cast("long") if style == "media" else F.floor(seconds + 0.5).cast("long")
    if style == "media":
        short = F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)
        return F.when(whole >= 3600, F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)).otherwise(short)
    minutes = F.floor(whole / 60)
    if style == "clock":
        return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "00:00").otherwise(F.format_string("%02d:%02d", minutes, whole % 60))
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "0s").when(minutes > 0, F.format_string("%dm %ds", minutes, whole % 60)).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def format_ts(seconds: Column, fmt: str = "srt", style: str = "total") -> Column:
    """total rounds to whole milliseconds first; parts rounds each part, and can write 1000 milliseconds."""
    mark = "," if fmt == "srt" else "."
    if style == "total":
        ms = F.floor(seconds * 1000 + 0.5).cast("long")
        hours, minutes, rest, milli = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    else:
        whole = F.floor(seconds).cast("long")
        hours, minutes, rest, milli = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.floor((seconds - whole) * 1000 + 0.5).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", hours, minutes, rest, milli)


def parse_ts(text: Column) -> Column:
    """h:m:s, m:s or s, with a comma or a dot; a part that is no number counts as 0."""
    parts = F.split(F.regexp_replace(F.trim(text), ",", "."), ":")
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + F.coalesce(p.try_cast("double"), F.lit(0.0)))


def classify_error(error: Column, url: Column | None = None) -> Column:
    """the first category whose words the error holds; other errors lose their technical prefix. With the url, a
    login error of a story is "story", and an unreadable reel, or whatever the error calls facebook, is "reel"."""
    low = F.lower(error)
    place = F.lower(F.coalesce(url, F.lit(""))) if url is not None else None
    out = F.when(F.lit(False), "")
    for category, words in ERROR_WORDS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        if place is not None and category == "login":
            out = out.when(hit & place.contains("stories"), "story")
        if place is not None and category == "unparsable":
            out = out.when(hit & (place.contains("reel") | low.contains("facebook")), "reel")
        out = out.when(hit, category)
    return out.otherwise(F.coalesce(F.nullif(F.trim(F.regexp_replace(error, r"ERROR:\s*\[.*?\]\s*", "")), F.lit("")), F.lit("unknown")))


def route_group(path: Column, status: Column, probe: Column) -> Column:
    """F12, for reports (span_name gives the name itself): the group of a request for traces, with file, status, cancel and stream paths folded."""
    out = F.when(probe, "probe")
    for prefix in ("file", "status", "cancel", "stream"):
        out = out.when(path.startswith(f"/api/{prefix}/"), f"/api/{prefix}/*")
    known = ("/api/convert/file", "/api/download", "/api/info", "/api/remove-bg", "/api/transcribe", "/api/pixel/detect", "/api/pixel/fix", "/api/pixel/health")
    return out.when(path.isin(*known), path).when(status >= 400, F.format_string("error %d", status)).otherwise("other")


# What traces call a request. {} stands for its path, its method or its status.
SPAN_PROBE = "🛡️ [Security Probe] {method} {path} (HTTP {status})"
SPAN_NAMES = {
    "/api/convert/file": "🌐 [Gateway] Chuyển đổi tài liệu (/api/convert/file)",
    "/api/download": "🌐 [Gateway] Tải Media (/api/download)",
    "/api/info": "🌐 [Gateway] Lấy thông tin Media (/api/info)",
    "/api/remove-bg": "🌐 [Gateway] Tách nền ảnh AI (/api/remove-bg)",
    "/api/transcribe": "🌐 [Gateway] Nhận diện giọng nói (/api/transcribe)",
    "/api/pixel/detect": "🌐 [Gateway] Nhận diện lưới pixel (/api/pixel/detect)",
    "/api/pixel/fix": "🌐 [Gateway] Tái tạo Pixel Art (/api/pixel/fix)",
    "/api/pixel/health": "🌐 [Gateway] Kiểm tra PixelFixer Health (/api/pixel/health)",
}
SPAN_PREFIXES = {
    "/api/file/": "🌐 [Gateway] Tải file kết quả ({path})",
    "/api/status/": "🌐 [Gateway] Kiểm tra tiến độ ({path})",
    "/api/cancel/": "🌐 [Gateway] Hủy tiến trình ({path})",
    "/api/stream/": "🌐 [Gateway] Stream tiến độ ({path})",
}
SPAN_ERROR = "🌐 [Gateway] Lỗi {status} ({method} {path})"
SPAN_OTHER = "🌐 [Gateway] {method} {path}"


def span_name(method: Column, path: Column, status: Column, probe: Column) -> Column:
    """a request's display name in traces: a probe's, that of a known path, of a family of paths, of an error, or the request itself."""
    parts = {"method": method, "path": path, "status": status.cast("string")}

    def fill(text: str) -> Column:
        pieces = [p for p in re.split(r"\{(\w+)\}", text)]
        return F.concat(*[parts[p] if k % 2 else F.lit(p) for k, p in enumerate(pieces) if p])

    out = F.when(probe, fill(SPAN_PROBE))
    for known, name in SPAN_NAMES.items():
        out = out.when(path == known, F.lit(name))
    for prefix, name in SPAN_PREFIXES.items():
        out = out.when(path.startswith(prefix), fill(name))
    return out.when(status >= 400, fill(SPAN_ERROR)).otherwise(fill(SPAN_OTHER))


def parse_traceparent(header: Column) -> Column:
    """struct of trace_id and parent_id; nulls if the header isn't one."""
    parts = F.split(header, "-")
    good = header.startswith("00-") & (F.size(parts) >= 3) & (F.length(F.get(parts, F.lit(1))) == 32)
    return F.struct(F.when(good, F.get(parts, F.lit(1))).alias("trace_id"), F.when(good, F.get(parts, F.lit(2))).alias("parent_id"))


def build_traceparent(trace_id: Column, span_id: Column) -> Column:
    return F.concat(F.lit("00-"), trace_id, F.lit("-"), span_id, F.lit("-01"))


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    """the first forwarded address, else the real one, else the peer's host."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(F.get(F.split(forwarded, ","), F.lit(0))), blank(real), F.regexp_replace(peer, r":\d+$", ""))


def span_status(status: Column) -> Column:
    """2 for server errors, else 1."""
    return F.when(status >= 500, 2).otherwise(1)


def span_end_nanos(start: Column, duration_ms: Column) -> Column:
    """start in nanoseconds plus the duration."""
    return start + (duration_ms * 1_000_000).cast("long")


def cpu_percent(cpu: Column, pre_cpu: Column, system: Column, pre_system: Column, cpus: Column) -> Column:
    """F16: share of the counters' differences; null if the system didn't move or the counter fell."""
    n = F.when(F.coalesce(cpus, F.lit(0)) == 0, 1).otherwise(cpus)
    return F.when((system - pre_system > 0) & (cpu - pre_cpu >= 0), (cpu - pre_cpu) / (system - pre_system) * n * 100.0)


def map_font(name: Column, target: str | None = None) -> Column:
    """the target if given; else by family; unknown fonts become Times New Roman."""
    if target and target.strip():
        return F.lit(target.strip())
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *words: low.rlike("|".join(words))
    return (
        F.when(low == "", "Times New Roman")
        .when(has("mono", "courier", "typewriter", "nimbusmon"), "Courier New")
        .when(has("sans", "arial", "helvetica"), "Arial")
        .when(has("roman", "times", "cmr", "cmmi", "cmsy", "cmex", "nimbusrom"), "Times New Roman")
        .when(F.trim(low).isin(*FONTS), name)
        .otherwise("Times New Roman")
    )


def mask_secret(secret: Column) -> Column:
    """the first and last four signs of a longer secret."""
    return F.when(F.length(secret) > 8, F.concat(F.substring(secret, 1, 4), F.lit("***"), F.substring(secret, -4, 4))).otherwise("***")


def display_name(username: Column, email: Column) -> Column:
    """the name, else the mailbox, else User."""
    return F.coalesce(F.nullif(username, F.lit("")), F.nullif(F.substring_index(email, "@", 1), F.lit("")), F.lit("User"))


def token_claims(token: Column) -> Column:
    """uid, email and provider from a token's payload, for reports only: the signature is not checked."""
    payload = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = lambda p: F.rpad(p, (F.ceil(F.length(p) / 4) * 4).cast("int"), "=")
    read = lambda p: F.from_json(F.try_to_binary(padded(p), F.lit("base64")).cast("string"), "user_id string, sub string, email string, firebase struct<sign_in_provider:string>")

    def told(claims: Column) -> Column:
        provider, uid = claims["firebase"]["sign_in_provider"], F.coalesce(claims["user_id"], claims["sub"])
        kind = F.when(provider.contains("google"), "google").when(provider.contains("github"), "github").when(provider.contains("password"), "email").otherwise("demo")
        return F.struct(uid.alias("uid"), F.coalesce(claims["email"], F.concat(uid, F.lit("@example.com"))).alias("email"), kind.alias("provider"))

    # lambdas, so a payload is decoded and parsed once, not once for each use of a claim
    return F.transform(F.transform(F.array(payload), read), told)[0]


def progress_percent(percent: Column, style: str = "task") -> Column:
    """task clamps to 0 to 100, gateway leaves as is, download maps a ratio to 15 to 80."""
    if style == "gateway":
        return percent
    if style == "download":
        return F.least(F.lit(15.0) + percent * 65.0, F.lit(80.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))


def segments_from_text(df: DataFrame, key: str, text: str, seconds: float = 4.0) -> DataFrame:
    """the lines that aren't blank as segments of equal length."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), F.trim), lambda x: x != "")
    rows = df.select(key, F.posexplode(lines).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).alias("id"), (F.col("pos") * seconds).alias("start"), ((F.col("pos") + 1) * seconds).alias("end"), F.col("line").alias("text"))


def infer_target(ext: Column, has_options: Column) -> Column:
    """a PDF without options becomes docx, all else pdf."""
    return F.when((ext == ".pdf") & ~has_options, "docx").otherwise("pdf")


def real_time_factor(wall: Column, media: Column) -> Column:
    """time taken for each second of media."""
    return F.when(media > 0, wall / media)


def safe_duration(timeout: float, factor: Column) -> Column:
    """what fits in three quarters of the timeout."""
    return F.when(factor > 0, 0.75 * timeout / factor)

"""Predicates over requests, files, jobs and sessions: native columns, so Catalyst can reorder and push them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed names, and paths and names that are refused.
FORMATS = ("mp3", "mp4", "m4a", "wav", "flac", "webm")
QUALITIES = ("64", "128", "192", "256", "320", "360", "480", "720", "1080", "1440", "2160", "best")
UPLOADS = {
    "convert": (".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".odt", ".ods", ".odp", ".rtf", ".txt", ".csv", ".pdf"),
    "transcribe": (".mp3", ".mp4", ".wav", ".m4a", ".webm", ".flac", ".ogg", ".aac", ".mov", ".avi", ".mkv"),
    "image": (".png", ".jpg", ".jpeg", ".webp", ".bmp"),
}
INTERNAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]", "169.254.169.254")
PROBE_SUFFIXES = (".php", ".key", ".pem", ".crt", ".env", ".bak", ".sql", ".log", ".yml", ".yaml", ".ini", ".conf", ".config", ".sh", ".py", ".go", ".rb", ".asp", ".aspx", ".jsp", ".cgi")
PROBE_PATTERNS = ("/wp-", "/phpmyadmin", "/admin-ajax", "/actuator", "appsettings.json", "stripe-keys.json", "master.key", "credentials", "/etc/passwd", "/etc/shadow")
BLOCKED_NAMES = ("package.json", "package-lock.json", "tsconfig.json", "vite.config.js", "vite.config.ts", "docker-compose.yml", "docker-stack.yml", "dockerfile", "appsettings.json", "stripe-keys.json", "master.key", "credentials", "passwd", "shadow", "access.log", "error.log")
BLOCKED_PREFIXES = ("/wp-", "/phpmyadmin", "/admin", "/actuator", "/etc/", "/var/")
BLOCKED_SUFFIXES = (".go", ".py", ".sh", ".ts", ".tsx", ".env", ".lock", ".php", ".key", ".pem", ".crt", ".bak", ".sql", ".log", ".yml", ".yaml", ".ini", ".conf", ".config", ".rb", ".asp", ".aspx", ".jsp", ".cgi")
SENSITIVE = (".env", ".git", "wp-", "admin", "phpmyadmin", ".yaml", ".yml", ".json", "passwd", "config")
HEALTH_PATHS = ("/health", "/api/health", "/api/pixel/health")
HEAVY_PATHS = ("/api/download", "/api/transcribe", "/api/remove-bg", "/api/convert")
ERROR_MARKS = ("panic:", "fatal:", "traceback (most recent", "unhandled exception", "critical:")
OUTPUTS = {"transcribe": ("txt", "srt", "vtt", "json")}
TASKS = ("transcribe", "translate")


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_http_url(url: Column) -> Column:
    """Http or https after trimming; null and empty are refused."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return u.startswith("http://") | u.startswith("https://")


def is_internal_url(url: Column) -> Column:
    """Loopback or link-local host; what can't be parsed counts as internal."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return host.isNull() | host.isin(*INTERNAL_HOSTS) | host.startswith("127.") | host.startswith("169.254.")


def normalize_request(df: DataFrame) -> DataFrame:
    """Format and quality trimmed, lower-cased, defaulted; reason is null for an allowed request."""
    fmt = F.coalesce(F.nullif(F.lower(F.trim("format")), F.lit("")), F.lit("mp3"))
    df = df.withColumn("format", fmt)
    quality = F.coalesce(F.nullif(F.lower(F.trim("quality")), F.lit("")), F.when(F.col("format") == "mp4", "720").otherwise("320"))
    df = df.withColumn("quality", quality)
    reason = F.when(~is_http_url(F.col("url")), "url").when(~F.col("format").isin(*FORMATS), "format").when(~F.col("quality").isin(*QUALITIES), "quality")
    return df.withColumn("reason", reason)


def is_allowed_upload(ext: Column, task: str) -> Column:
    """The extension, with its dot, is on the task's list."""
    return F.coalesce(F.lower(ext).isin(*UPLOADS[task]), F.lit(False))


def is_allowed_output(form: Column, task: str) -> Column:
    """The output format, without case or leading dots, is on the task's list."""
    return F.coalesce(F.regexp_replace(F.lower(form), r"^\.+", "").isin(*OUTPUTS[task]), F.lit(False))


def is_allowed_task(task: Column) -> Column:
    """What a transcription may be asked to do."""
    return F.coalesce(F.trim(F.lower(task)).isin(*TASKS), F.lit(False))


def check_signature(ext: Column, content: Column) -> Column:
    """P5: null if the first 512 bytes fit the extension, else the reason."""
    head = F.hex(F.substring(content, 1, 512))
    begins = lambda *texts: _any([head.startswith(t.encode("latin-1").hex().upper()) for t in texts])
    code = begins("MZ", "\x7fELF", "<!DOCTYPE", "<html", "<script", "<svg")
    # hex digits come in pairs: the mark must begin at an even place
    pdf = head.rlike("^(..)*" + b"%PDF-".hex().upper())
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
        .when((ext == ".pdf") & ~pdf, "no pdf header")
        .when((ext == ".pdf") & (code | begins("<?xml", "#!/bin")), "polyglot")
        .when(ext.isin(".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp") & ~head.startswith("504B0304"), "no zip container")
        .when(ext.isin(".doc", ".xls", ".ppt") & ~head.startswith("D0CF11E0A1B11AE1"), "no ole container")
        .when((ext == ".rtf") & ~begins("{\\rtf"), "no rtf header")
        .when(ext.isin(".txt", ".csv") & code, "code in text")
    )


def within_duration(seconds: Column, limit: float) -> Column:
    """A null duration counts as 0 and passes; the limit itself passes."""
    return F.coalesce(seconds, F.lit(0.0)) <= F.lit(limit)


def within_image_limits(width: Column, height: Column, size: Column, task: str) -> Column:
    """25 million pixels for the background task; 4096 squared pixels and 35 MiB for upscaling."""
    area = width.cast("long") * height.cast("long")
    return area <= 25_000_000 if task == "background" else (area <= 4096 * 4096) & (size <= 35 * 1024 * 1024)


def _hidden(path: Column) -> Column:
    return path.contains("..") | F.exists(F.split(path, "/"), lambda s: F.trim(s).startswith(".") & (F.trim(s) != "."))


def is_probe_path(path: Column) -> Column:
    """The proxy's probe rule."""
    p = F.lower(path)
    return _hidden(p) | _any([p.endswith(x) for x in PROBE_SUFFIXES]) | _any([p.contains(x) for x in PROBE_PATTERNS])


def clean_path(path: Column) -> Column:
    """A path in its shortest form: no empty or "." parts, each ".." undone by the part before it, no slash at the end; empty is "."."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    # the parts so far; ".." takes the last one away, above a root it says nothing
    gone = lambda so_far: F.slice(so_far, 1, F.greatest(F.size(so_far) - 1, F.lit(0)))
    stays = lambda so_far: (F.size(so_far) == 0) | (F.element_at(so_far, -1) == "..")
    up = lambda so_far: F.when(F.size(so_far) == 0, F.when(rooted, so_far).otherwise(F.array(F.lit("..")))).when(stays(so_far), F.concat(so_far, F.array(F.lit("..")))).otherwise(gone(so_far))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda so_far, x: F.when(x == "..", up(so_far)).otherwise(F.concat(so_far, F.array(x))))
    return F.when(rooted, F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(F.coalesce(F.nullif(F.array_join(folded, "/"), F.lit("")), F.lit(".")))


def is_blocked_static(path: Column) -> Column:
    """The gateway's rule for static files, on the cleaned path."""
    p = F.lower(clean_path(path))
    base = F.element_at(F.split(p, "/"), -1)
    return _hidden(p) | base.startswith(".") | base.isin(*BLOCKED_NAMES) | _any([p.contains(x) for x in BLOCKED_PREFIXES]) | _any([base.endswith(x) for x in BLOCKED_SUFFIXES])


def trace_decision(path: Column, status: Column) -> Column:
    """P10: drop, keep or probe."""
    sensitive = _any([F.lower(path).contains(x) for x in SENSITIVE])
    return (
        F.when(path.isin(*HEALTH_PATHS) & (status < 500), "drop")
        .when(path.startswith("/api/"), F.when(sensitive, "probe").otherwise("keep"))
        .when((status >= 400) | sensitive, "probe")
        .otherwise("drop")
    )


def is_valid_job(job_id: Column, url: Column) -> Column:
    """Both are there and not empty."""
    return (F.length(F.coalesce(job_id, F.lit(""))) > 0) & (F.length(F.coalesce(url, F.lit(""))) > 0)


def is_safe_filename(name: Column) -> Column:
    """The name is a base name by itself, not empty or a dot, without control marks."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.coalesce((base == name) & ~base.isin("", ".", "..") & ~base.rlike(r"[\x00\r\n]"), F.lit(False))


def is_error_line(line: Column) -> Column:
    """A mark of a crash, in any case."""
    return _any([F.lower(line).contains(x) for x in ERROR_MARKS])


def is_terminal(status: Column) -> Column:
    """Such a job can't be cancelled any more."""
    return status.isin("completed", "error", "cancelled")


def is_heavy_call(method: Column, path: Column) -> Column:
    """What the rate limiter counts."""
    return (method == "POST") & _any([path.startswith(x) for x in HEAVY_PATHS])


def is_valid_session(status: Column, expires_at: Column, now: Column) -> Column:
    """Active, and not past its expiry; null never expires."""
    return (status == "active") & (expires_at.isNull() | (now <= expires_at))


def active_users(users: DataFrame) -> DataFrame:
    """Users that aren't deleted."""
    return users.where("is_active")


def is_whole_disk(device: Column) -> Column:
    """Neither a virtual device nor a partition."""
    return ~device.rlike(r"^(loop|ram|dm-|md|sr|zram)") & ~device.rlike(r"^(sd[a-z]+|vd[a-z]+|hd[a-z]+|xvd[a-z]+)\d+$|^(nvme\d+n\d+|mmcblk\d+)p\d+$")

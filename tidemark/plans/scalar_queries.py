"""Queries of the predicates and scalar functions over the stand-in views, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import scalars as S

from .standins import view

C = F.col


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _or(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


HIDDEN = "(contains(lower(path), '..') OR len(list_filter(string_split(lower(path), '/'), lambda s: starts_with(trim(s), '.') AND trim(s) <> '.')) > 0)"
BASE = "regexp_extract(lower(path), '[^/]*$')"
SENSITIVE = _or(f"contains(lower(path), '{x}')" for x in P.SENSITIVE)
HTTP = "(starts_with(trim(coalesce(url, '')), 'http://') OR starts_with(trim(coalesce(url, '')), 'https://'))"
HOST = r"lower(nullif(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), ''))"
YT = r"(contains(coalesce(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1), ''), 'youtube.com') OR contains(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1), 'youtu.be'))"
VIDEO = r"nullif(regexp_extract('&' || regexp_extract(u, '\?([^#]*)', 1), '&v=([^&]+)', 1), '')"
SHORT = r"CASE WHEN contains(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1), 'youtu.be') THEN nullif(regexp_extract(u, '^[a-z]+://[^/]+/([^?#]*)', 1), '') END"
KEPT = r"list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(p, '^(fbclid|utm_)') AND NOT starts_with(p, 'mibextid='))"
CLEAN = rf"CASE WHEN {YT} AND coalesce({VIDEO}, {SHORT}) IS NOT NULL THEN 'https://www.youtube.com/watch?v=' || coalesce({VIDEO}, {SHORT})"
FULL = rf"{CLEAN} ELSE regexp_extract(u, '^[^?#]*') || CASE WHEN len({KEPT}) > 0 THEN '?' || array_to_string({KEPT}, '&') ELSE '' END END"
GATEWAY = rf"{CLEAN} ELSE u END"
SECONDS = "CAST(value AS DOUBLE) * 17"

QUERIES = {
    "p1_http_url": (lambda s, d: view(s, d, "urls").select("page_id", P.is_http_url(C("url")).alias("ok")), f"SELECT page_id, {HTTP} AS ok FROM {{urls}}"),
    "p2_internal_url": (
        lambda s, d: view(s, d, "urls").select("page_id", P.is_internal_url(F.trim("url")).alias("internal")),
        f"SELECT page_id, {HOST} IS NULL OR {HOST} IN {_in(P.INTERNAL_HOSTS)} OR starts_with({HOST}, '127.') OR starts_with({HOST}, '169.254.') AS internal FROM (SELECT page_id, trim(url) AS url FROM {{urls}})",
    ),
    "p3_normalize_request": (
        lambda s, d: P.normalize_request(view(s, d, "urls")).select("page_id", "format", "quality", "reason"),
        f"""SELECT page_id, format, quality, CASE WHEN NOT {HTTP} THEN 'url' WHEN format NOT IN {_in(P.FORMATS)} THEN 'format' WHEN quality NOT IN {_in(P.QUALITIES)} THEN 'quality' END AS reason
        FROM (SELECT page_id, url, format, coalesce(nullif(lower(trim(quality)), ''), CASE WHEN format = 'mp4' THEN '720' ELSE '320' END) AS quality
          FROM (SELECT page_id, url, quality, coalesce(nullif(lower(trim(format)), ''), 'mp3') AS format FROM {{urls}}))""",
    ),
    "p4_allowed_upload": (
        lambda s, d: view(s, d, "files").select("doc_id", *[P.is_allowed_upload(F.regexp_extract("filename", r"(\.[^.]+)$", 1), t).alias(t) for t in P.UPLOADS]),
        "SELECT doc_id, " + ", ".join(rf"lower(regexp_extract(filename, '(\.[^.]+)$', 1)) IN {_in(v)} AS {k}" for k, v in P.UPLOADS.items()) + " FROM {files}",
    ),
    "p5_signature": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", P.check_signature(F.element_at(F.array(F.lit(".pdf"), F.lit(".txt"), F.lit(".docx"), F.lit(".rtf"), F.lit(".csv")), (C("page_id") % 5 + 1).cast("int")), F.when(C("page_id") % 10 == 0, F.concat(F.lit("%PDF-1.7"), C("html"))).when(C("page_id") % 10 == 3, F.concat(F.lit("{\\rtf1"), C("html"))).when(C("page_id") % 10 == 4, "a,b").otherwise(C("html")).cast("binary")).alias("reason")),
        r"""SELECT page_id, CASE WHEN length(c) = 0 THEN 'empty' WHEN ext = '.pdf' AND NOT contains(h, '%PDF-') THEN 'no pdf header'
          WHEN ext = '.pdf' AND (starts_with(h, '<!DOCTYPE') OR starts_with(h, '<html')) THEN 'polyglot' WHEN ext = '.docx' THEN 'no zip container'
          WHEN ext = '.rtf' AND NOT starts_with(h, '{\rtf') THEN 'no rtf header' WHEN ext IN ('.txt', '.csv') AND (starts_with(h, '<!DOCTYPE') OR starts_with(h, '<html')) THEN 'code in text' END AS reason
        FROM (SELECT page_id, ext, c, left(c, 200) AS h FROM (SELECT page_id, ['.pdf', '.txt', '.docx', '.rtf', '.csv'][(page_id % 5 + 1)::INT] AS ext,
          CASE page_id % 10 WHEN 0 THEN '%PDF-1.7' || html WHEN 3 THEN '{\rtf1' || html WHEN 4 THEN 'a,b' ELSE html END AS c FROM pages))""",
    ),
    "p6_duration": (
        lambda s, d: view(s, d, "segments").select("media_id", "id", P.within_duration(C("end"), 600.0).alias("speech"), P.within_duration(C("end"), 10800.0).alias("media")),
        'SELECT media_id, id, coalesce("end", 0) <= 600 AS speech, coalesce("end", 0) <= 10800 AS media FROM {segments}',
    ),
    "p7_image_limits": (
        lambda s, d: view(s, d, "images").select("image_id", P.within_image_limits(C("width") * 9, C("height") * 9, C("size"), "background").alias("background"), P.within_image_limits(C("width") * 9, C("height") * 9, C("size"), "upscale").alias("upscale")),
        "SELECT image_id, width::BIGINT * 9 * height * 9 <= 25000000 AS background, width::BIGINT * 9 * height * 9 <= 16777216 AND size <= 36700160 AS upscale FROM {images}",
    ),
    "p8_probe_path": (
        lambda s, d: view(s, d, "requests").select("event_id", P.is_probe_path(C("path")).alias("probe")),
        f"SELECT event_id, {HIDDEN} OR {_or(f'''ends_with(lower(path), '{x}')''' for x in P.PROBE_SUFFIXES)} OR {_or(f'''contains(lower(path), '{x}')''' for x in P.PROBE_PATTERNS)} AS probe FROM {{requests}}",
    ),
    "p9_blocked_static": (
        lambda s, d: view(s, d, "requests").select("event_id", P.is_blocked_static(C("path")).alias("blocked")),
        f"SELECT event_id, {HIDDEN} OR {BASE} IN {_in(P.BLOCKED_NAMES)} OR {_or(f'''contains(lower(path), '{x}')''' for x in P.BLOCKED_PREFIXES)} OR {_or(f'''ends_with({BASE}, '{x}')''' for x in P.BLOCKED_SUFFIXES)} AS blocked FROM {{requests}}",
    ),
    "p10_trace_decision": (
        lambda s, d: view(s, d, "requests").select("event_id", P.trace_decision(C("path"), C("status_code")).alias("decision")),
        f"""SELECT event_id, CASE WHEN path IN {_in(P.HEALTH_PATHS)} AND status_code < 500 THEN 'drop' WHEN starts_with(path, '/api/') THEN CASE WHEN {SENSITIVE} THEN 'probe' ELSE 'keep' END
          WHEN status_code >= 400 OR {SENSITIVE} THEN 'probe' ELSE 'drop' END AS decision FROM {{requests}}""",
    ),
    "p11_valid_job": (lambda s, d: view(s, d, "jobs").select("job_id", P.is_valid_job(C("job_id"), C("url")).alias("valid")), "SELECT job_id, length(job_id) > 0 AND length(url) > 0 AS valid FROM {jobs}"),
    "p12_safe_filename": (
        lambda s, d: view(s, d, "requests").select("event_id", P.is_safe_filename(F.when(C("event_id") % 3 == 0, F.substring("path", 2, 99)).when(C("event_id") % 3 == 1, F.element_at(F.split("path", "/"), -1)).otherwise(F.lit("."))).alias("safe")),
        r"SELECT event_id, CASE event_id % 3 WHEN 2 THEN false WHEN 1 THEN regexp_extract(path, '[^/]*$') NOT IN ('', '.', '..') ELSE NOT contains(substr(path, 2), '/') AND substr(path, 2) NOT IN ('', '.', '..') END AS safe FROM {requests}",
    ),
    "p13_error_line": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", P.is_error_line(F.concat(F.when(C("doc_id") % 4 == 0, "PANIC: ").when(C("doc_id") % 4 == 1, "note: critical: ").otherwise(""), C("text"))).alias("error")),
        f"SELECT doc_id, {_or(f'''contains(lower(t), '{x}')''' for x in P.ERROR_MARKS)} AS error FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PANIC: ' WHEN 1 THEN 'note: critical: ' ELSE '' END || text AS t FROM documents)",
    ),
    "p14_terminal": (lambda s, d: view(s, d, "job_events").groupBy("status", P.is_terminal(C("status")).alias("terminal")).agg(F.count("*").alias("n")), "SELECT status, status IN ('completed', 'error', 'cancelled') AS terminal, count(*) AS n FROM {job_events} GROUP BY ALL"),
    "p15_heavy_call": (
        lambda s, d: view(s, d, "requests").where(P.is_heavy_call(C("method"), C("path"))).groupBy("path").agg(F.count("*").alias("n")),
        f"SELECT path, count(*) AS n FROM {{requests}} WHERE method = 'POST' AND {_or(f'''starts_with(path, '{x}')''' for x in P.HEAVY_PATHS)} GROUP BY path",
    ),
    "p16_valid_session": (
        lambda s, d: view(s, d, "sessions").select("id", P.is_valid_session(C("status"), C("expires_at"), F.lit("1998-01-01").cast("timestamp_ntz")).alias("valid")),
        "SELECT id, status = 'active' AND (expires_at IS NULL OR TIMESTAMP '1998-01-01' <= expires_at) AS valid FROM {sessions}",
    ),
    "p17_active_users": (lambda s, d: P.active_users(view(s, d, "users")).select("id"), "SELECT id FROM {users} WHERE is_active"),
    "p18_whole_disk": (
        lambda s, d: view(s, d, "requests").select("event_id", P.is_whole_disk(F.element_at(F.array(*map(F.lit, ("sda", "sda1", "nvme0n1", "nvme0n1p2", "loop3", "dm-0", "vdb", "sr0"))), (C("event_id") % 8 + 1).cast("int"))).alias("whole")),
        "SELECT event_id, event_id % 8 IN (0, 2, 6) AS whole FROM {requests}",
    ),
    "f1_clean_url": (lambda s, d: view(s, d, "urls").select("page_id", S.clean_url(C("url")).alias("clean")), f"SELECT page_id, {FULL} AS clean FROM (SELECT page_id, trim(url) AS u FROM {{urls}})"),
    "f2_clean_url_gateway": (lambda s, d: view(s, d, "urls").select("page_id", S.clean_url(C("url"), "gateway").alias("clean")), f"SELECT page_id, {GATEWAY} AS clean FROM (SELECT page_id, trim(url) AS u FROM {{urls}})"),
    "f3_cache_keys": (
        lambda s, d: S.cache_keys(P.normalize_request(view(s, d, "urls"))).select("page_id", "key_md5", "key_sha", "key_raw"),
        f"""SELECT page_id, substr(md5(clean || e), 1, 10) AS key_md5, substr(sha256(clean || e), 1, 10) AS key_sha, substr(sha256(u || e), 1, 12) AS key_raw FROM (
          SELECT page_id, u, {GATEWAY} AS clean, '_' || format || '_' || coalesce(nullif(lower(trim(quality)), ''), CASE WHEN format = 'mp4' THEN '720' ELSE '320' END) AS e
          FROM (SELECT page_id, trim(url) AS u, quality, coalesce(nullif(lower(trim(format)), ''), 'mp3') AS format FROM {{urls}}))""",
    ),
    "f4_sanitize_name": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", *[S.sanitize_name(C("url"), x).alias(x) for x in ("media", "document", "image", "pixel", "upscale")]),
        r"""SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(url, '[\\/*?:"<>|]', '', 'g'), '\s+', ' ', 'g')), 1, 120), ''), 'download') AS media,
          coalesce(nullif(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.-]', '_', 'g'), '^[._\- ]+|[._\- ]+$', '', 'g'), ''), 'document') AS document,
          regexp_replace(url, '[^a-zA-Z0-9_\-.]', '_', 'g') AS image, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS pixel, regexp_replace(url, '[^\p{L}\p{N}_-]', '', 'g') AS upscale FROM pages""",
    ),
    "f5_display_filename": (lambda s, d: view(s, d, "files").select("doc_id", S.display_filename(C("filename")).alias("name")), "SELECT doc_id, regexp_replace(filename, '^[^_]*_', '') AS name FROM {files}"),
    "f6_mime_type": (
        lambda s, d: view(s, d, "files").groupBy(S.mime_type(F.regexp_extract("filename", r"(\.[^.]+)$", 1)).alias("mime")).agg(F.count("*").alias("n")),
        r"SELECT CASE lower(regexp_extract(filename, '(\.[^.]+)$', 1)) WHEN '.mp3' THEN 'audio/mpeg' WHEN '.mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM {files} GROUP BY 1",
    ),
    "f7_format_bytes": (
        lambda s, d: view(s, d, "images").select("image_id", S.format_bytes(C("size") * C("image_id")).alias("gateway"), S.format_bytes(C("size") % 5000, "client").alias("client")),
        """SELECT image_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0) ELSE printf('%.1f TB', b / 1099511627776.0) END AS gateway,
          CASE WHEN c = 0 THEN '0 B' WHEN c < 1024 THEN c || ' B' ELSE regexp_replace(printf('%.1f', c / 1024.0), '\\.0$', '') || ' KB' END AS client
        FROM (SELECT image_id, size * image_id AS b, size % 5000 AS c FROM {images})""".replace("\\\\", "\\"),
    ),
    "f8_format_duration": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.format_duration(C("value") * 17).alias("media"), S.format_duration(C("value") * 17, "clock").alias("clock")),
        f"""SELECT event_id, CASE WHEN w >= 3600 THEN printf('%d:%02d:%02d', w // 3600, w % 3600 // 60, w % 60) ELSE printf('%d:%02d', w // 60, w % 60) END AS media, printf('%02d:%02d', r // 60, r % 60) AS clock
        FROM (SELECT event_id, floor({SECONDS})::BIGINT AS w, floor({SECONDS} + 0.5)::BIGINT AS r FROM events)""",
    ),
    "f9_timestamps": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.format_ts(C("value") * 17).alias("srt"), S.format_ts(C("value") * 17, "vtt", "parts").alias("vtt")),
        f"""SELECT event_id, printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS srt, printf('%02d:%02d:%02d.%03d', w // 3600, w // 60 % 60, w % 60, p) AS vtt
        FROM (SELECT event_id, floor({SECONDS} * 1000 + 0.5)::BIGINT AS m, floor({SECONDS})::BIGINT AS w, floor(({SECONDS} - floor({SECONDS})) * 1000 + 0.5)::BIGINT AS p FROM events)""",
    ),
    "f10_parse_time": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.round(S.parse_ts(S.format_ts(C("value") * 17)), 3).alias("seconds")),
        f"SELECT event_id, round(floor({SECONDS} * 1000 + 0.5) / 1000, 3) AS seconds FROM events",
    ),
    "f11_classify_error": (
        lambda s, d: view(s, d, "requests").select("event_id", S.classify_error(F.element_at(F.array(*map(F.lit, ("ERROR: [x] Sign in to continue", "HTTP Error 400", "Private video", "ERROR: [youtube] strange thing", "blocked in your country", "Read timed out"))), (C("event_id") % 6 + 1).cast("int"))).alias("category")),
        "SELECT event_id, ['login', 'unparsable', 'private', 'strange thing', 'region', 'timeout'][(event_id % 6 + 1)::INT] AS category FROM {requests}",
    ),
    "f12_route_group": (
        lambda s, d: view(s, d, "requests").select("event_id", S.route_group(C("path"), C("status_code"), P.trace_decision(C("path"), C("status_code")) == "probe").alias("route")).groupBy("route").agg(F.count("*").alias("n")),
        f"""SELECT CASE WHEN probe THEN 'probe' WHEN starts_with(path, '/api/status/') THEN '/api/status/*' WHEN path IN ('/api/download', '/api/pixel/health', '/api/convert/file') THEN path WHEN status_code >= 400 THEN 'error ' || status_code ELSE 'other' END AS route, count(*) AS n
        FROM (SELECT path, status_code, NOT (path IN {_in(P.HEALTH_PATHS)} AND status_code < 500) AND ((starts_with(path, '/api/') AND {SENSITIVE}) OR (NOT starts_with(path, '/api/') AND (status_code >= 400 OR {SENSITIVE}))) AS probe FROM {{requests}}) GROUP BY 1""",
    ),
    "f12_span_name": (
        lambda s, d: view(s, d, "requests").select("event_id", S.span_name(C("method"), C("path"), C("status_code"), P.trace_decision(C("path"), C("status_code")) == "probe").alias("name")),
        f"""SELECT event_id, CASE WHEN probe THEN '🛡️ [Security Probe] ' || method || ' ' || path || ' (HTTP ' || status_code || ')' WHEN starts_with(path, '/api/status/') THEN '🌐 [Gateway] Kiểm tra tiến độ (' || path || ')'
          WHEN path = '/api/download' THEN '🌐 [Gateway] Tải Media (/api/download)' WHEN path = '/api/pixel/health' THEN '🌐 [Gateway] Kiểm tra PixelFixer Health (/api/pixel/health)' WHEN path = '/api/convert/file' THEN '🌐 [Gateway] Chuyển đổi tài liệu (/api/convert/file)'
          WHEN status_code >= 400 THEN '🌐 [Gateway] Lỗi ' || status_code || ' (' || method || ' ' || path || ')' ELSE '🌐 [Gateway] ' || method || ' ' || path END AS name
        FROM (SELECT event_id, method, path, status_code, NOT (path IN {_in(P.HEALTH_PATHS)} AND status_code < 500) AND ((starts_with(path, '/api/') AND {SENSITIVE}) OR (NOT starts_with(path, '/api/') AND (status_code >= 400 OR {SENSITIVE}))) AS probe FROM {{requests}})""",
    ),
    "f13_traceparent": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.parse_traceparent(F.when(C("event_id") % 3 == 0, F.lit("bad")).otherwise(S.build_traceparent(F.md5(C("event_type")), F.substring(F.md5(C("event_id").cast("string")), 1, 16)))).alias("t")).select("event_id", "t.*"),
        "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN md5(event_type) END AS trace_id, CASE WHEN event_id % 3 > 0 THEN substr(md5(event_id::VARCHAR), 1, 16) END AS parent_id FROM events",
    ),
    "f14_client_ip": (
        lambda s, d: view(s, d, "requests").select("event_id", S.client_ip(C("forwarded"), C("real_ip"), C("peer")).alias("ip")),
        "SELECT event_id, coalesce(nullif(trim(string_split(forwarded, ',')[1]), ''), nullif(trim(real_ip), ''), string_split(peer, ':')[1]) AS ip FROM {requests}",
    ),
    "f15_span_fields": (
        lambda s, d: view(s, d, "requests").select("event_id", S.span_status(C("status_code")).alias("code"), S.span_end_nanos(F.unix_micros(C("ts").cast("timestamp")) * 1000, F.round("duration_ms")).alias("end_nanos")),
        "SELECT event_id, CASE WHEN status_code >= 500 THEN 2 ELSE 1 END AS code, epoch_us(ts) * 1000 + round(duration_ms)::BIGINT * 1000000 AS end_nanos FROM {requests}",
    ),
    "f16_cpu_percent": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.round(S.cpu_percent(F.floor("value"), F.lit(20), C("event_id"), F.lit(5000), (C("event_id") % 3).cast("int")), 6).alias("cpu")),
        "SELECT event_id, CASE WHEN event_id > 5000 AND floor(value) >= 20 THEN round((floor(value) - 20) / (event_id - 5000) * CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END * 100.0, 6) END AS cpu FROM events",
    ),
    "f17_rounding": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.round_half_away(C("value") - 50, 1).alias("away"), S.round_half_even(C("value") * 2, 0).alias("even")),
        "SELECT event_id, sign(value - 50) * floor(abs(value - 50) * 10 + 0.5) / 10 AS away, round_even(value * 2, 0) AS even FROM events",
    ),
    "f18_map_font": (
        lambda s, d: view(s, d, "requests").select("event_id", S.map_font(F.element_at(F.array(*map(F.lit, ("CMR10", "DejaVu Sans", "Courier Prime", "Georgia", "Odd", ""))), (C("event_id") % 6 + 1).cast("int"))).alias("font")),
        "SELECT event_id, ['Times New Roman', 'Arial', 'Courier New', 'Georgia', 'Times New Roman', 'Times New Roman'][(event_id % 6 + 1)::INT] AS font FROM {requests}",
    ),
    "f19_mask_secret": (lambda s, d: view(s, d, "files").select("doc_id", S.mask_secret(F.expr("substr(filename, 1, CAST(doc_id % 20 AS INT))")).alias("masked")), "SELECT doc_id, CASE WHEN length(x) > 8 THEN left(x, 4) || '***' || right(x, 4) ELSE '***' END AS masked FROM (SELECT doc_id, substr(filename, 1, (doc_id % 20)::INT) AS x FROM {files})"),
    "f20_display_name": (lambda s, d: view(s, d, "users").select("id", S.display_name(C("username"), C("email")).alias("name")), "SELECT id, coalesce(nullif(username, ''), nullif(string_split(email, '@')[1], ''), 'User') AS name FROM {users}"),
    "f21_token_claims": (
        lambda s, d: view(s, d, "users").select("id", S.token_claims(F.concat(F.lit("h."), F.translate(F.regexp_replace(F.base64(F.to_json(F.struct(C("firebase_uid").alias("sub"), "email", F.struct(F.when(C("id") % 2 == 0, "google.com").otherwise("password").alias("sign_in_provider")).alias("firebase"))).cast("binary")), "[=\r\n]", ""), "+/", "-_"), F.lit(".s"))).alias("c")).select("id", "c.*"),
        "SELECT id, firebase_uid AS uid, coalesce(email, firebase_uid || '@example.com') AS email, CASE WHEN id % 2 = 0 THEN 'google' ELSE 'email' END AS provider FROM {users}",
    ),
    "f24_progress": (
        lambda s, d: view(s, d, "job_events").select("job_id", "seq", "part", "price", S.progress_percent(C("percent") + 30).alias("task"), F.round(S.progress_percent(C("percent") / 90, "download"), 6).alias("download")),
        "SELECT job_id, seq, part, price, greatest(0, least(100, percent + 30)) AS task, round(least(15 + percent / 90 * 65, 80), 6) AS download FROM {job_events}",
    ),
    "f25_text_segments": (
        lambda s, d: S.segments_from_text(s.read.parquet(f"{d}/conversations.parquet").withColumn("key", F.concat_ws("-", "conv_id", "turn")), "key", "text"),
        """SELECT key, row_number() OVER (PARTITION BY key ORDER BY i)::INT AS id, (row_number() OVER (PARTITION BY key ORDER BY i) - 1) * 4.0::DOUBLE AS start, row_number() OVER (PARTITION BY key ORDER BY i) * 4.0::DOUBLE AS "end", text
        FROM (SELECT conv_id || '-' || turn AS key, trim(unnest(string_split(text, chr(10)))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE text <> ''""",
    ),
    "f26_infer_target": (
        lambda s, d: view(s, d, "files").groupBy(S.infer_target(F.when(C("doc_id") % 2 == 0, ".pdf").otherwise(".docx"), C("in_tmp")).alias("target")).agg(F.count("*").alias("n")),
        "SELECT CASE WHEN doc_id % 2 = 0 AND NOT in_tmp THEN 'docx' ELSE 'pdf' END AS target, count(*) AS n FROM {files} GROUP BY 1",
    ),
    "f27_real_time_factor": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.avg(S.real_time_factor(C("value"), C("user_id") * 2.0)).alias("rtf")).select("event_type", F.round("rtf", 6).alias("rtf"), F.round(S.safe_duration(600.0, C("rtf")), 4).alias("safe")),
        "SELECT event_type, round(r, 6) AS rtf, round(450.0 / r, 4) AS safe FROM (SELECT event_type, avg(CASE WHEN user_id > 0 THEN value / (user_id * 2.0) END) AS r FROM events GROUP BY 1)",
    ),
}

"""Inputs of the operators, derived from the given tables by SQL that Spark and DuckDB both read; {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "requests": """
        SELECT event_id, ts, CAST(user_id % 4 AS INT) AS node, user_id, value AS duration_ms,
          CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status_code,
          CASE event_id % 13 WHEN 0 THEN '/api/download' WHEN 1 THEN '/health' WHEN 2 THEN '/.git/config' WHEN 3 THEN '/wp-login.php' WHEN 4 THEN '/static/app.js'
            WHEN 5 THEN '/admin' WHEN 6 THEN '/api/status/' || CAST(event_id AS STRING) WHEN 7 THEN '/index.html' WHEN 8 THEN '/etc/passwd' WHEN 9 THEN '/A/b.PY'
            WHEN 10 THEN '/package.json' WHEN 11 THEN '/api/pixel/health' ELSE '/api/convert/file' END AS path,
          CASE WHEN event_type IN ('click', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
          CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || CAST(user_id AS STRING) || ', 10.1.1.1' WHEN event_id % 3 = 1 THEN '' END AS forwarded,
          CASE WHEN event_id % 2 = 0 THEN '10.2.0.' || CAST(user_id AS STRING) END AS real_ip,
          '10.3.0.' || CAST(user_id AS STRING) || ':443' AS peer
        FROM {events}""",
    "urls": """
        SELECT page_id, CASE page_id % 7
            WHEN 0 THEN url
            WHEN 1 THEN 'https://www.youtube.com/watch?utm_source=a&v=ID' || CAST(page_id AS STRING) || '&t=3'
            WHEN 2 THEN ' https://youtu.be/ID' || CAST(page_id AS STRING) || '?si=x'
            WHEN 3 THEN 'https://media.example.com/p/' || CAST(page_id AS STRING) || '?utm_source=a&id=' || CAST(page_id AS STRING) || '&fbclid=zz&empty=&b=2#top'
            WHEN 4 THEN 'ftp://files.example.com/' || CAST(page_id AS STRING)
            WHEN 5 THEN 'http://127.0.0.' || CAST(page_id % 5 AS STRING) || ':8080/x'
            ELSE 'http://169.254.169.254/latest' END AS url,
          CASE page_id % 5 WHEN 0 THEN ' MP3 ' WHEN 1 THEN 'mp4' WHEN 2 THEN '' WHEN 3 THEN 'exe' END AS format,
          CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '720' ELSE 'Best' END AS quality
        FROM {pages}""",
    "samples": "SELECT event_type AS service, event_id, ts, CASE WHEN value > 100 THEN 100.0 ELSE value END AS cpu FROM {events}",
    "counters": """
        SELECT event_type AS host, event_id, ts, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id) % 40000 AS BIGINT) AS bytes,
          CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS idle,
          CAST(sum(CAST(floor(value * 2) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS total
        FROM {events}""",
    "job_events": """
        SELECT CAST(l_orderkey AS STRING) AS job_id, l_linenumber AS seq, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price,
          CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 45 THEN 'cancelled' ELSE 'downloading' END AS status,
          2 * l_quantity AS percent, CASE WHEN l_returnflag = 'N' AND l_quantity > 48 THEN 'failed' END AS error
        FROM {lineitem}""",
    "jobs": """
        SELECT CAST(o_orderkey AS STRING) AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'downloading' ELSE 'processing' END AS status,
          CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'https://e.example.com/' || CAST(o_orderkey AS STRING) END AS url, CAST(o_orderkey AS STRING) || '_clip.mp4' AS filename, o_orderdate AS created
        FROM {orders}""",
    "users": "SELECT c_custkey AS id, 'fb' || CAST(c_custkey AS STRING) AS firebase_uid, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS username, CASE WHEN c_custkey % 5 > 0 THEN 'm' || CAST(c_custkey AS STRING) || '@example.com' END AS email, c_acctbal > 0 AS is_active FROM {customer}",
    "sessions": "SELECT o_orderkey AS id, o_custkey AS user_id, 't' || CAST(o_orderkey AS STRING) AS firebase_token, CASE o_orderstatus WHEN 'F' THEN 'revoked' ELSE 'active' END AS status, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate + INTERVAL 1 HOUR END AS expires_at, o_orderdate AS created FROM {orders}",
    "segments": """
        SELECT conv_id AS media_id, CAST(turn AS INT) AS id, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS DOUBLE) / 15 AS start,
          CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) / 15 - 0.25 AS "end", text
        FROM {conversations}""",
    "files": """
        SELECT doc_id, substr(md5('https://files.example.com/' || CAST(doc_id AS STRING) || '_mp3_320'), 1, 10) || '_' || source || CASE doc_id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.mp4' WHEN 2 THEN '.part' ELSE '.mp3' END AS filename,
          n_chars AS size, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(doc_id % 120 AS INT) AS mtime, doc_id % 5 = 0 AS in_tmp
        FROM {documents}""",
    "file_requests": "SELECT doc_id AS request_id, 'https://files.example.com/' || CAST(doc_id AS STRING) AS url, CASE WHEN doc_id % 2 = 0 THEN 'mp3' ELSE 'MP3' END AS format, '320' AS quality FROM {documents}",
    "findings": """
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'secrets' ELSE 'scan' END AS tool, CASE doc_id % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'critical' WHEN 3 THEN 'info' END AS severity, source AS path, n_chars AS line
        FROM {documents}""",
    "images": "SELECT p_partkey AS image_id, 100 + CAST(p_partkey * 37 % 1500 AS INT) AS width, 80 + CAST(p_partkey * 53 % 1100 AS INT) AS height, CAST(p_retailprice * 40000 AS BIGINT) AS size FROM {part}",
    "spans": "SELECT CAST(event_id - event_id % 10 AS BIGINT) AS trace_id, event_id AS span_id, CASE WHEN event_id % 10 > 0 THEN event_id - 1 - event_id % 3 % (event_id % 10) END AS parent_span_id, value FROM {events}",
}

#: Columns whose name is a keyword are quoted as each engine wants it.
QUOTED = re.compile(r'"(\w+)"')


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(QUOTED.sub(r"`\1`", sql), **tables)


def oracle(sql: str) -> str:
    """The query for DuckDB: the views that it names in braces come first."""
    used = sorted({n for n in re.findall(r"\{(\w+)\}", sql) if n in VIEWS})
    heads = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in used]
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    if not heads:
        return body
    return f"WITH RECURSIVE {', '.join(heads)}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")

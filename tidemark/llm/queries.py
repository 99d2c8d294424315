"""The registered queries of this subpackage, with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import centroid_clusters
from .decontamination import find_benchmark
from .exact_dedup import exact_dedup
from .licenses import scan_licenses
from .line_dedup import line_dedup
from .mixing import mix_sources
from .quality import quality_scores
from .secrets import secret_digest
from .simhash_dedup import simhash_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity_scores
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place of a license."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("licenses").alias("x")).select("doc_id", "x.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    white = whiten(table(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"), "n", "deviation", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "x.whitened", "x.explained", "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_secret_scans": op3_secret_scans,
        "op4_source_mixing": op4_source_mixing,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_toxicity": op6_toxicity,
        "op7_license_scans": op7_license_scans,
        "op8_line_dedup": op8_line_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_suffix_array_dedup": op11_suffix_array_dedup,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i, trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE line <> ''
), r AS (
  SELECT *, lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3 FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), f AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, k) > 1 AS later FROM r WHERE line3 IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, k + o AS k FROM f, (VALUES (0), (1), (2)) v(o) WHERE later
), m AS (
  SELECT n.doc_id, n.i FROM n JOIN g ON n.doc_id = g.doc_id AND n.k = g.k
), s AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.i) AS text FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.i = m.i WHERE m.i IS NULL GROUP BY s.doc_id
)
SELECT d.doc_id, coalesce((SELECT count(*) FROM n WHERE n.doc_id = d.doc_id), 0)::BIGINT AS n_lines,
  coalesce((SELECT count(*) FROM m WHERE m.doc_id = d.doc_id), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
    coalesce(sum(cap) OVER b, 0) AS full_caps, coalesce(sum(weight) OVER b, 0)::BIGINT AS full_weights
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - full_caps) / (weights - full_weights) AS level FROM f
), t AS (
  SELECT source, source_size, CASE WHEN level * weight > cap THEN cap
    ELSE weight * min_by(level, full_weights) FILTER (WHERE NOT level * weight > cap) OVER () END AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""


OP12_ROUND = """, a{r} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v,
    min({{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS best
  FROM v, c{r} GROUP BY r
), s{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i
), c{next} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m
  FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c) n ON c{r}.c = n.c
)"""

OP12_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), f AS (
  SELECT v AS m, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, m LIMIT 40
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, m) - 1 AS c, m FROM f
)"""
    + "".join(OP12_ROUND.format(r=r, next=r + 1) for r in range(6))
    + """
SELECT vec_id, a5.best.c::INT AS cluster, a5.best.d AS distance, (sum(a5.best.d) OVER (PARTITION BY a5.best.c))::BIGINT AS cluster_inertia,
  (sum(a5.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.m, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON a5.best.c = c5.c
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_source_mixing": OP4_SQL, "op8_line_dedup": OP8_SQL, "op12_centroid_clustering": OP12_SQL}

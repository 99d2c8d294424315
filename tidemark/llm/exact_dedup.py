"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, body, fresh, inner_id, join_checked, outer_id, written

#: What makes two texts equal: SHA-256, and beside it an independent 64-bit hash and the length, which verify it.
KEY = ["digest", "check", "n_bytes"]
#: Pieces into which the merge of as many runs as there are input partitions is dealt, for each of these runs.
PIECES = 16


def merged(runs: DataFrame, fan_in: int, slices: int) -> DataFrame:
    """The next level of the tree: fan_in neighbouring runs (run, lead, *KEY, keep, n) become one, sorted by digest.

    The runs exchange stretches of digests: a task gets the same stretch of all of them, merges these in order, and of
    neighbours with equal, verified digests keeps the smallest identifier and the sum of counts. As a run
    has a digest once, fan_in rows are the most that meet."""
    stretch = F.floor(F.col("lead") * F.lit(float(slices)) / F.lit(float(1 << 24))).cast("int")
    moved = runs.select(F.floor(F.col("run") / fan_in).cast("int").alias("run"), stretch.alias("stretch"), "lead", *KEY, "keep", "n")
    moved = moved.repartition("run", "stretch").sortWithinPartitions("run", "stretch", *KEY, "keep")
    equal = Window.partitionBy("run", "stretch", *KEY).orderBy("keep")
    every = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = moved.withColumn("n", F.sum("n").over(every)).withColumn("place", F.row_number().over(equal)).where("place = 1")
    return first.select("run", "lead", *KEY, "keep", "n")


def exact_dedup(docs: DataFrame, fan_in: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, text_hash), a row for each input row.

    Texts are equal when they are identical after each stretch of ASCII white space has become one space.
    Each input partition is a run: its digests sorted, each once with its smallest doc_id and count. In each round
    fan_in neighbouring runs merge (merged), so a tree of log(partitions) levels ends in one run, dealt over the
    cluster by stretches of digests; a group of copies has at most one row for each run and level, however large it is.
    The answers go back down the same tree, so no level joins more than fan_in rows for a digest, and documents meet
    only the answer of their own run, which is one input partition.

    Null text counts as empty. A null doc_id sorts after all others; a group of only null ids has a null keep_id.
    Of rows with the same doc_id and text, all have kept true if that doc_id stays (they count in group_size).
    An empty table gives an empty result; other columns are ignored."""
    plain = F.regexp_replace(body(text), SPACES, " ")
    leaves = docs.select(inner_id(doc_id).alias("id"), plain.alias("plain")).select(
        "id", F.sha2("plain", 256).alias("hex"), F.xxhash64("plain").alias("check"), F.octet_length("plain").alias("n_bytes"), F.spark_partition_id().alias("run")
    )
    leaves = leaves.select("id", F.unhex("hex").alias("digest"), "check", "n_bytes", "run", F.conv(F.substring("hex", 1, 6), 16, 10).cast("int").alias("lead"))
    # a written table: the run of a row stays the same however often later jobs read it
    leaves = written(leaves.sortWithinPartitions("digest"), "digest-runs")
    count = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    levels = [leaves.groupBy("run", "lead", *KEY).agg(F.min("id").alias("keep"), F.count("*").alias("n"))]
    slices = PIECES
    while count > 1:
        count, slices = -(-count // fan_in), slices * fan_in
        levels.append(written(merged(levels[-1], fan_in, slices), "digest-level"))
    answer = levels.pop()
    while levels:
        down = levels.pop().select("run", *KEY, F.floor(F.col("run") / fan_in).cast("int").alias("above"))
        answer = down.join(answer.select(F.col("run").alias("above"), *KEY, "keep", "n"), ["above", *KEY]).select("run", *KEY, "keep", "n")
    return leaves.join(answer.select("run", *KEY, "keep", "n"), ["run", *KEY]).select(
        outer_id("id").alias("doc_id"),
        outer_id("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("check").alias("text_hash"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that exact_dedup keeps, columns as they were; of rows with the same doc_id and text one stays.

    Null texts are copies of empty ones. A null doc_id stays only where all of its group are null, and then one row does.
    An empty table gives an empty one; columns may have any names."""
    same_text = F.xxhash64(F.regexp_replace(body(text), SPACES, " "))
    row, tag = fresh(docs, "copy_id", "copy_hash")
    keys = [F.col("id").alias(row), F.col("text_hash").alias(tag)]
    same = (inner_id(doc_id) == F.col(row)) & (same_text == F.col(tag))
    marked = written(exact_dedup(docs, text=text, doc_id=doc_id, **options).withColumn("id", inner_id("doc_id")), "copies")
    copies = written(marked.where("NOT kept").select(*keys).distinct(), "copies")
    rest = join_checked(docs, copies, same, "left_anti", rows=500_000)
    twice = marked.where("kept").groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    twice = written(twice.select(*keys), "copies")
    if twice.isEmpty():
        return rest
    once = join_checked(rest, twice, same, rows=500_000).dropDuplicates([row, tag]).select(*[rest[c] for c in docs.columns])
    return join_checked(rest, twice, same, "left_anti", rows=500_000).unionByName(once)

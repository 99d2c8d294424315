"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, inner_id, join_counted, once, outer_id, written

#: Most line numbers (an int each) that are broadcast.
BROADCAST_STARTS = 4_000_000


def lines_of(column: str) -> Column:
    """The lines of a text that aren't blank, as (at, text): at counts all lines from 0, text is trimmed."""
    every = F.transform(F.split(F.col(column), "\n", -1), lambda x, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(x, r"[\x09-\x0D]", " ")).alias("line")))
    return F.filter(every, lambda x: x["line"] != "")


def line_dedup(docs: DataFrame, run: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, kept_text), a row for each input row.

    A repeat is `run` consecutive lines that stand, the same and consecutive, at an earlier place too: in a document with a
    smaller doc_id, or earlier in the same document. All lines that lie in repeats go. Lines are compared trimmed;
    blank lines don't count as lines, don't interrupt runs and always stay.

    Winnowing: of each `run` consecutive line hashes the smallest is a fingerprint (the rightmost of equals), so equal runs
    always share one. Fingerprints that occur once are dropped by aggregation; the others are seeds, each with the hashes
    of run - 1 lines to both sides. A seed extends to every run that contains it, a run's earliest place is found by
    aggregation, and later places unite to maximal repeats. A line that very many documents share costs rows in
    proportion to them, never pairs. A document's own lines are the largest thing that a row holds.

    Null text has no lines. A null doc_id counts as larger than all others. Rows with the same doc_id and text are one
    document; with different texts they are ordered by text hash. An empty table gives an empty result; other columns are ignored."""
    rows = docs.select(inner_id(doc_id).alias("id"), body(text).alias("text")).withColumn("tag", F.xxhash64("text"))
    # the second hash, beside the first, tells runs apart whose first hashes are equal by chance
    both = F.transform(lines_of("text"), lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("c")))
    seen = written(rows.select("id", "tag", both.alias("both"), F.sha2("text", 256).alias("sha")), "line-hashes")
    seen = seen.select("id", "tag", F.size("both").cast("long").alias("n_lines"), F.col("both.h").alias("hs"), F.col("both.c").alias("cs"), "sha")

    # arrays are read by number: F.slice in a lambda copies the whole array, and so does a row exploded beside one
    window = lambda i: F.array(*[F.get("hs", i + k) for k in range(run)])
    last_min = lambda i: once(window(i), lambda w: (i + run - F.array_position(F.reverse(w), F.array_min(w))).cast("int"))
    documents = seen.where(F.size("hs") >= run).select("id", "tag", "hs", "cs").dropDuplicates(["id", "tag"])
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("hs") - run), last_min))
    around = lambda p: F.sequence(F.greatest(p - (run - 1), F.lit(0)), F.least(p + (run - 1), F.size("hs") - 1))
    part = lambda column, p: F.transform(around(p), lambda j: F.get(column, j))
    seed = lambda p: F.struct(F.greatest(p - (run - 1), F.lit(0)).alias("begin"), F.get("hs", p).alias("print"), part("hs", p).alias("near"), part("cs", p).alias("check"))
    seeds = documents.select("id", "tag", F.explode(F.transform(picks, seed)).alias("seed")).select("id", "tag", "seed.*")
    seeds = written(seeds, "line-seeds")
    shared = written(seeds.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "line-prints")
    runs = join_counted(seeds, shared, ["print"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("near") - run)))
    runs = runs.select("id", "tag", (F.col("begin") + F.col("k")).alias("start"), F.xxhash64(F.slice("near", F.col("k") + 1, run)).alias("r1"), F.hash(F.slice("check", F.col("k") + 1, run)).alias("r2")).distinct()
    runs = written(runs, "line-runs")
    place = F.struct("id", "tag", "start")
    first = runs.groupBy("r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_counted(runs, written(first, "line-firsts"), ["r1", "r2"]).where(place > F.col("first"))
    gone = later.groupBy("id", "tag").agg(F.collect_list("start").alias("starts"))
    gone = written(gone, "line-repeats")

    # what is broadcast has been counted: the starts of all repeats; beyond the bound Spark shuffles the texts
    many = gone.agg(F.sum(F.size("starts"))).first()[0] or 0
    cut = rows.join(F.broadcast(gone) if many <= BROADCAST_STARTS else gone, ["id", "tag"])
    hit = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + run - 1))))
    at = once(lines_of("text"), lambda lines: F.transform(hit, lambda i: F.get(lines, i)["at"]))
    # hash sets and look-ups by number, so the work grows with the lines and not with their square
    stays = lambda out, every: F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), out), lambda i: F.get(every, i))
    left = lambda out: once(F.split("text", "\n", -1), lambda every: F.array_join(stays(out, every), "\n"))
    kept = lambda out: F.struct(F.size(out).cast("long").alias("n_cut"), left(out).alias("kept_text"))
    cut = cut.select("id", "tag", once(at, kept).alias("c")).dropDuplicates(["id", "tag"]).select("id", "tag", "c.n_cut", "c.kept_text")
    cut = written(cut, "line-cuts")
    return (
        seen.select("id", "tag", "n_lines", "sha")
        .join(cut, ["id", "tag"], "left")
        .select(
            outer_id("id").alias("doc_id"),
            "n_lines",
            F.coalesce("n_cut", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce(F.sha2("kept_text", 256), "sha").alias("kept_sha256"),
            "kept_text",
        )
    )

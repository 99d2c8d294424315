"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, body, fresh, join_checked, written


def draw(seed: str, *columns: str) -> Column:
    """A number in [0, 1) that only the seed and the columns fix: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): targets in words for the sources of sizes (source, size).

    Sources by code point, null last, weigh as weights say, repeating; together they get share times all sizes.
    A target stops at most times its source's size and the excess goes to the others by weight: sources are filled in
    order of limit per weight, so running sums give the level at which the rest stands.
    The windows run over one row for each source, after aggregation, never over documents."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    sources = sources.withColumn("weight", turn).withColumn("limit", most * F.col("source_size"))
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.select(
        "source", "source_size", "weight", "limit",
        (share * F.sum("source_size").over(every)).alias("all_targets"),
        F.sum("weight").over(every).alias("all_weights"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weights"),
    )
    level = (F.col("all_targets") - F.col("full")) / (F.col("all_weights") - F.col("full_weights"))
    sources = sources.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > F.col("limit"))
    # the first source that isn't filled up has the level of all that follow
    stands = F.min(F.when(~F.col("stops"), F.struct("full_weights", "level"))).over(every)["level"]
    return sources.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(stands * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for each input row.

    size is the number of words of the whole text (null: 0). A source repeats at rate target / source_size: each of
    its documents is taken floor(rate) times and once more with the fraction as probability, by a draw that only the
    seed and doc_id fix, so reruns agree and rows with the same doc_id share their draw (null ids share one, too).
    A source without words has target 0 and nothing is taken. Null is a source of its own, the last.
    An empty table gives an empty result; other columns are ignored."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(body(text), F.lit(WORD)).cast("long").alias("size"))
    sizes = written(sizes, "mix-sizes")
    targets = written(source_targets(sizes, weights, share, most).withColumnRenamed("source", "of"), "mix-targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        join_checked(sizes, targets, F.col("source").eqNullSafe(F.col("of")))
        .select("doc_id", "size", "source_size", "target", rate.alias("rate"), draw(seed, "doc_id").alias("draw"))
        .select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Columns as they were; rows without words follow their source's rate.

    Null doc_ids share one draw, a null source is a source of its own, a null text has no words. An empty table gives an
    empty one; columns may have any names."""
    keys = options.get("doc_id", "doc_id"), options.get("source", "source"), options.get("text", "text")
    sizes = written(docs.select(F.col(keys[1]).cast("string").alias("source"), F.regexp_count(body(keys[2]), F.lit(WORD)).cast("long").alias("size")), "mix-sizes")
    names = {k: v for k, v in options.items() if k in ("weights", "share", "most")}
    targets = source_targets(sizes, **names)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    of, rates, copy = fresh(docs, "mix_source", "mix_rate", "mix_copy")
    table = written(targets.select(F.col("source").alias(of), rate.alias(rates)), "mix-rates")
    extra = F.when(draw(options.get("seed", "mix"), keys[0]) < F.col(rates) - F.floor(rates), 1).otherwise(0)
    times = (F.floor(rates) + extra).cast("int")
    joined = join_checked(docs, table, F.col(keys[1]).cast("string").eqNullSafe(F.col(of)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*[docs[c] for c in docs.columns])

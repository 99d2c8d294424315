"""Top rows, samples, tails, tiles and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """L1, L3: the first n rows of each key; Spark filters on the rank inside the sort, before the window is complete."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_findings(df: DataFrame, section: str, order: Sequence, n: int) -> DataFrame:
    """L2: the first n rows of each section, and how many more there are."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(*order)))
    more = df.groupBy(section).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return ranked.where(F.col("rank") <= n).join(more, section)


def divisor_candidates(steps: DataFrame, key: str, step: str, confidence: str | int = 100, n: int = 5) -> DataFrame:
    """L3: the sizes that a grid may have: its step, rounded, with the detectors' confidence, and those common divisors whose ratio to the
    step is within 0.15 of a whole number, by 70 - 150 times the difference, whole, at least 15 and at most ten below the
    step's own; the n best, then the smaller. confidence: a column, or a number for all."""
    sure = F.col(confidence) if isinstance(confidence, str) else F.lit(confidence)
    own = F.round(step).cast("int")
    rows = steps.select(key, F.col(step).alias("step_"), own.alias("own_"), sure.cast("int").alias("sure_"), F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 4, 6, 8, 12, 16)])).alias("size"))
    ratio = F.col("step_") / F.col("size")
    diff = F.abs(F.round(ratio) - ratio)
    raw = F.floor(F.greatest(70 - 150 * diff, F.lit(20.0))).cast("int")
    capped = F.greatest(F.least(raw, F.greatest(F.col("sure_") - 10, F.lit(0))), F.lit(15))
    others = rows.where((F.col("size") != F.col("own_")) & (diff < 0.15)).select(key, "size", capped.alias("confidence"))
    primary = steps.select(key, own.alias("size"), sure.cast("int").alias("confidence")).where("size >= 1")
    return top_rows(primary.union(others), [key], [F.desc("confidence"), "size"], n)


def even_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], m: int) -> DataFrame:
    """L4: m rows of each key, evenly spaced by rank; all if there are no more."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("i_", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_", F.count("*").over(w))
    # row i is picked if some k in 0..m-1 has floor(k (n - 1) / (m - 1)) = i
    k = F.ceil(F.col("i_") * (m - 1) / F.greatest(F.col("n_") - 1, F.lit(1)))
    picked = (F.col("n_") <= m) | ((k <= m - 1) & (F.floor(k * (F.col("n_") - 1) / (m - 1)) == F.col("i_")))
    return rows.where(picked).drop("i_", "n_")


def tail(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return top_rows(df, keys, [F.desc(order)], n).drop("rank")


def tile_grid(images: DataFrame, scale: int = 2) -> DataFrame:
    """Tiles of 512 (scale 2) or 256 (scale 4) pixels with ragged edges, and where they go in the result."""
    side = 512 if scale == 2 else 256
    rows = images.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(side)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(side))))
    size = lambda whole, at: F.least(F.lit(side), F.col(whole) - F.col(at))
    return rows.select("image_id", "x", "y", size("width", "x").alias("w"), size("height", "y").alias("h"), (F.col("x") * scale).alias("out_x"), (F.col("y") * scale).alias("out_y"))


def union_findings(*feeds: DataFrame) -> DataFrame:
    """All feeds with their columns aligned by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def distinct_colors(pixels: DataFrame) -> DataFrame:
    """The colours of each image's pixels that aren't transparent."""
    return pixels.where("a > 0").select("image_id", "r", "g", "b").distinct()

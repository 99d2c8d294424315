"""Exact quantiles of groups of any size: small groups in one aggregation, larger ones by distributed selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import made_since, mark, release, written

#: Rows of a group that one aggregation's buffer may hold.
MOST = 1_000_000
#: Rows around a wanted rank that are sorted at last.
FEW = 10_000
#: Splitters of a round. Each leaves about this part of the rows around a wanted rank.
SPLITS = 64


def small(values: DataFrame, by: Sequence[str], most: int = MOST) -> bool:
    """Whether no group has more than `most` rows, so that one aggregation may hold each."""
    return (values.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= most


def ranks(points: Sequence[float], n: Column, kind: str) -> Column:
    """The ranks, from 0, that the quantiles of n values are made of: an array for each point, of one rank or of two neighbours."""
    if kind == "disc":
        return F.array(*[F.array(F.greatest(F.ceil(F.lit(float(p)) * n) - 1, F.lit(0)).cast("long")) for p in points])
    if kind == "floor":
        return F.array(*[F.array(F.least(F.floor(F.lit(float(p)) * n), n - 1).cast("long")) for p in points])
    at = lambda p: F.lit(float(p)) * (n - 1)
    return F.array(*[F.array(F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")) for p in points])


def select_ranks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g_, rank, x): of rows (g_, v_) the value x at each wanted (g_, rank), ranks from 0 by value.

    In rounds: around each wanted rank a sketch of bounded size proposes splitters, rows are counted between them (and at them, so
    that a value of very many copies is an answer of its own), and running sums of the counts tell where the rank lies. When
    few rows are left around it these are sorted. No buffer grows with a group."""
    spark = rows.sparkSession
    end = F.lit(None).cast("double")
    state = written(wanted.select("g_", "rank", end.alias("low"), end.alias("high"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("left"), end.alias("x")), "ranks")
    key = ["g_", "rank"]
    inside = (F.col("low").isNull() | (F.col("v_") > F.col("low"))) & (F.col("high").isNull() | (F.col("v_") < F.col("high")))

    def around(ranges: DataFrame) -> DataFrame:
        # wanted ranks are a few for each group; Spark splits the rows of a hot group
        return rows.join(ranges.select("g_", "rank", "low", "high"), "g_").where(inside)

    while True:
        begun = mark() - 1
        open_ = state.where((F.col("x").isNull()) & (F.col("left").isNull() | (F.col("left") > FEW)))
        if open_.isEmpty():
            break
        open_ = written(open_, "ranks-open")
        splits = around(open_).groupBy(*key).agg(F.percentile_approx("v_", [k / SPLITS for k in range(SPLITS + 1)], 20 * SPLITS).alias("s_"))
        splits = written(splits.select(*key, F.array_distinct("s_").alias("s_")), "ranks-splits")
        place = F.size(F.filter("s_", lambda s: s <= F.col("v_")))
        hit = F.get("s_", place - 1) == F.col("v_")
        # at the k-th splitter: 2k; after it: 2k + 1
        slots = around(open_).join(splits, key).groupBy(*key, (2 * place + F.when(hit, 0).otherwise(1)).alias("slot")).agg(F.count("*").alias("n"))
        so_far = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        slots = slots.withColumn("sum_", F.coalesce(F.sum("n").over(so_far), F.lit(0))).join(open_, key).join(splits, key)
        mine = slots.where((F.col("rank") - F.col("before") >= F.col("sum_")) & (F.col("rank") - F.col("before") < F.col("sum_") + F.col("n")))
        k = F.floor(F.col("slot") / 2).cast("int")
        at = F.col("slot") % 2 == 0
        found = mine.select(
            *key, F.coalesce(F.get("s_", k - 1), "low").alias("low"), F.coalesce(F.get("s_", k), "high").alias("high"), (F.col("before") + F.col("sum_")).alias("before"), F.col("n").alias("left"), F.when(at, F.get("s_", k - 1)).alias("x")
        )
        state = written(state.join(open_, key, "left_anti").unionByName(found), "ranks")
        release(spark, made_since(begun, but_last=True))
    last = state.where("x IS NULL")
    ordered = around(last).withColumn("k_", F.row_number().over(Window.partitionBy(*key).orderBy("v_")) - 1)
    rest = ordered.join(last.select(*key, "before"), key).where(F.col("k_") == F.col("rank") - F.col("before")).select(*key, F.col("v_").alias("x"))
    return state.where("x IS NOT NULL").select(*key, "x").unionByName(rest)


def quantiles(values: DataFrame, by: Sequence[str], value: str, points: Sequence[float], kind: str = "linear", most: int = MOST) -> DataFrame:
    """(by, q): for each group the exact quantiles at points, as an array of doubles: linearly interpolated, or (disc) the first value whose
    share of the rows up to it reaches the point, or (floor) the one at place floor(n p) from 0. Null values don't count; a group of
    nulls only has a null array.

    Groups are counted first. If none has more than `most` values an aggregation holds each group's; else ranks are selected
    by select_ranks. Both give the same."""
    rows = values.select(F.struct(*by).alias("g_"), F.col(value).cast("double").alias("v_"))
    sizes = written(rows.groupBy("g_").agg(F.count("v_").alias("n_")), "quantile-sizes")
    fields = [F.col(f"g_.{c}").alias(c) for c in by]
    if (sizes.agg(F.max("n_")).first()[0] or 0) <= most:
        if kind == "floor":
            n = F.count("v_")
            q = F.array(*[F.get(F.array_sort(F.collect_list("v_")), F.least(F.floor(F.lit(float(p)) * n), n - 1).cast("int")) for p in points])
        elif kind == "disc":
            q = F.array(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v_)") for p in points])
        else:
            q = F.percentile("v_", [float(p) for p in points])
        return rows.groupBy("g_").agg(q.alias("q"), F.count("v_").alias("n_")).select(*fields, F.when(F.col("n_") > 0, F.col("q")).alias("q"))
    pairs = sizes.where("n_ > 0").select("g_", "n_", F.posexplode(ranks(points, F.col("n_"), kind)).alias("point", "r_"))
    pairs = written(pairs, "quantile-ranks")
    wanted = pairs.select("g_", F.explode("r_").alias("rank")).distinct()
    held = written(rows.where("v_ IS NOT NULL"), "quantile-values")
    found = written(select_ranks(held, wanted), "quantile-found")
    each = pairs.select("g_", "n_", "point", F.posexplode("r_").alias("side", "rank")).join(found, ["g_", "rank"])
    at = F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("point") + 1) * (F.col("n_") - 1)
    low, high = (F.max(F.when(F.col("side") == k, F.col("x"))) for k in (0, 1))
    share = F.first(at - F.floor(at))
    x = low if kind != "linear" else low * (1 - share) + high * share
    met = each.groupBy("g_", "point").agg(x.alias("x")).groupBy("g_").agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "x"))), lambda s: s["x"]).alias("q"))
    return sizes.select("g_").join(met, "g_", "left").select(*fields, "q")

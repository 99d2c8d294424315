"""What the text operators share: word rules, shared-folder tables, size-checked joins, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.staging import made_since, mark, release, scope, shared_dir, written

__all__ = ["body", "components", "fresh", "inner_id", "join_checked", "join_counted", "lean", "once", "outer_id", "release", "scope", "shared_dir", "written"]

#: ASCII white space, and what is not: the only word rule used here.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A null doc_id is carried as this value inside an operator, so it sorts last and joins by plain equality.
NULL_ID = 2**63 - 1



def body(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def inner_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def outer_id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NULL_ID))


def once(value: Column, use) -> Column:
    """use(value), with value worked out once a row: it is bound by a lambda, which no rule of the optimizer unfolds."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lean(batches):
    """The batches, one at a time: what Arrow freed goes back to the machine before the next, so that workers, which live on, stay small."""
    import pyarrow as pa

    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


#: Largest side that is broadcast, in rows; its rows are a few numbers or short strings each.
BROADCAST_ROWS = 50_000


def join_checked(left: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a table that should be small: its rows are counted, and only then broadcast.

    Beyond the bound Spark shuffles both sides and splits skewed keys itself. small must be cheap to count
    (a written table)."""
    return left.join(F.broadcast(small) if small.count() <= rows else small, on, how)


#: A key with more than this part of all rows is hot. Fewer keys than its inverse can be so.
HOT = 1 / 1000


def join_counted(many: DataFrame, single: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """many with what single says of each key: inner join; n is dropped. Both must be cheap to read twice (written tables).

    single has a key once, and in column n how often many has it. Rows of hot keys meet a broadcast of fewer than 1 / HOT
    rows, whatever the data; no other key has more than a HOT part of all rows, so the shuffle deals the rest evenly."""
    total = single.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total * HOT
    few = single.where(hot)
    if few.isEmpty():
        return many.join(single.drop(n), on)
    cold = many.join(F.broadcast(few.select(*on)), on, "left_anti").join(single.where(~hot).drop(n), on)
    return many.join(F.broadcast(few.drop(n)), on).select(cold.columns).unionByName(cold)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node in edges (a, b: long); root is the smallest node that can be reached.

    Smallest neighbour label and pointer jumping in turn, a written table each round, until nothing changes.
    Only counts reach the driver. Hot nodes and hot roots are joined by their counts (join_counted)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, f"{label}-edges")
    # every edge stands in both directions, so n tells how often a node is either end
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count("*").alias("n")), label)
    while True:
        begun = mark() - 1  # where the state before was made
        seen = join_counted(both, state.withColumnRenamed("node", "b"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        now = state.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"), F.col("n").alias("ends"))
        now = written(now, label)
        # a root may be that of very many nodes, which are counted here
        up = now.groupBy("root").agg(F.count("*").alias("n")).join(state.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root")
        now = join_counted(now, written(up, label), ["root"]).select("node", "old", F.least("root", "higher").alias("root"), F.col("ends").alias("n"))
        now = written(now, label)
        release(both.sparkSession, made_since(begun, but_last=True))
        state = now.drop("old")
        if now.where("old <> root").isEmpty():
            return state.drop("n")

"""Tables that batches are merged into, as files of changes: a batch appends a run of its own rows, readers fold runs by key, and runs are
folded into larger ones level by level. What a batch writes follows the batch, not the table."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a level that are folded into one of the next.
FAN = 8
NAME = r"run-(\d+)-(\d+)-(\d+)"

#: Folds rows (with order_, larger for later runs) to one a key, of the same columns without order_. Folding folded rows again with
#: others must give what folding all of them at once gives.
Fold = Callable[[DataFrame], DataFrame]


class Run(NamedTuple):
    """The changes of batches first to last."""

    level: int
    first: int
    last: int
    path: str


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def runs(spark: SparkSession, path: str) -> list[Run]:
    """The runs that count, in order. A run counts once it is complete, unless one of a higher level holds its batches."""
    system, place = _files(spark, path)
    if not system.exists(place):
        return []
    found = []
    for status in system.listStatus(place):
        name = re.fullmatch(NAME, status.getPath().getName())
        if name and system.exists(_files(spark, f"{status.getPath()}/_SUCCESS")[1]):
            found.append(Run(*map(int, name.groups()), str(status.getPath())))
    above = lambda r: any(o.level > r.level and o.first <= r.first and r.last <= o.last for o in found)
    return sorted((r for r in found if not above(r)), key=lambda r: r.first)


def write_changes(changes: DataFrame, path: str, batch: int) -> None:
    """Adds a batch's rows. A batch that is written again replaces its run, or does nothing if that has been folded."""
    spark = changes.sparkSession
    if any(r.level and r.first <= batch <= r.last for r in runs(spark, path)):
        return
    changes.write.mode("overwrite").parquet(f"{path}/run-0-{batch}-{batch}")


def read_changes(spark: SparkSession, path: str, fold: Fold, some: list[Run] | None = None) -> DataFrame:
    """The table: a row a key, folded from all runs that count (or from some)."""
    paths = [r.path for r in (runs(spark, path) if some is None else some)]
    rows = spark.read.parquet(*paths)
    order = F.regexp_extract(F.col("_metadata.file_path"), NAME, 3).cast("long")
    return fold(rows.withColumn("order_", order))


def compact(spark: SparkSession, path: str, fold: Fold, fan: int = FAN) -> None:
    """Folds each `fan` runs of a level into one of the next, the oldest first. Readers see the old runs until the new one is complete, and
    the new one from then on; what it holds is deleted after that."""
    level = 0
    while old := [r for r in runs(spark, path) if r.level >= level]:
        old = [r for r in old if r.level == level]
        for k in range(0, len(old) - fan + 1, fan):
            part = old[k : k + fan]
            read_changes(spark, path, fold, part).write.mode("overwrite").parquet(f"{path}/run-{level + 1}-{part[0].first}-{part[-1].last}")
            for r in part:
                system, place = _files(spark, r.path)
                system.delete(place, True)
        level += 1


def upsert_batch(changes: DataFrame, path: str, batch: int, fold: Fold, fan: int = FAN) -> None:
    """A batch's changes, and compaction where it is due."""
    write_changes(changes, path, batch)
    compact(changes.sparkSession, path, fold, fan)

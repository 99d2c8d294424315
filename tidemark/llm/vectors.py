"""What the operators on vectors share: which vectors count, and their entries as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Neither null, nor with null, infinite or NaN entries."""
    x = F.col(vector)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & good, F.lit(False))


def whole(vector: str, scale: int, most: int, offset: int = 0, kind: str = "long") -> Column:
    """floor(scale * entry) + offset of each entry, from doubles. Entries of `most` or more in size end the query with an error: what is
    summed from them would leave the range of long, and no row is dropped in silence."""
    entry = lambda c: F.when(F.abs(c) < most, F.floor(scale * c) + offset).otherwise(F.raise_error(F.lit(f"an entry of {vector} is {most} or more in size")))
    return F.transform(F.col(vector).cast("array<double>"), lambda c: entry(c).cast(kind))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A column of lists of `dims` whole numbers as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)

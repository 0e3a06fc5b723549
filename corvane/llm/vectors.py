"""Columns of vectors: which take part, and their packed form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """True where the vector is there and all of its components are, as finite numbers."""
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))), F.lit(False))


def groups_by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) for each vector length in a list column."""
    lengths = np.asarray(pa.compute.list_value_length(column))
    values = np.asarray(column.flatten()).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    found = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        found.append((rows, values[starts[rows, None] + np.arange(n)]))
    return found

"""Rows of integer vectors, as the vector operators use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDEST = 2**62  # integers beyond this bound count as it


def finite(vector: str) -> Column:
    """Whether the vector is there and holds neither NULL nor a number that is not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd, F.lit(False))


def scaled(vector: str, scale: int, bound: Column | int = WIDEST) -> Column:
    """Every component times ``scale``, rounded down, as an integer within the bound."""
    limit = (bound if isinstance(bound, Column) else F.lit(bound)).cast("double")
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x * scale, -limit), limit)).cast("bigint"))


def by_width(column: pa.ListArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Width, rows and matrix of the vectors of a batch, one entry for each width."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    found = []
    for width in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == width)
        if len(rows) == len(lengths):
            found.append((width, rows, values.reshape(-1, width) if width else np.zeros((len(rows), 0), values.dtype)))
        else:
            found.append((width, rows, values[starts[rows][:, None] + np.arange(width)]))
    return found

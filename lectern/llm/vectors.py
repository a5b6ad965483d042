"""What the embedding operators share: which vectors take part, and equal ones as one class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, of one component or more, all of them finite and not null, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def element(df: DataFrame, vector: str) -> str:
    """numpy's name of the components' type."""
    return "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def as_double(df: DataFrame, vector: str) -> Column:
    """Floats stay as they are; other numbers become doubles."""
    return F.col(vector) if element(df, vector) == "<f4" else F.col(vector).cast("array<double>")


def matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Lists of one length (without nulls) as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)

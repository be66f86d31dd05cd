"""Vectors as they come in tables: which rows take part, and batches of them as arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def dimensions(vectors: DataFrame, vec_id: str, vector: str) -> int:
    """Length of the vector of the lowest id, among several the least; 0 if there is none."""
    row = vectors.agg(F.min(F.struct(F.col(vec_id).isNull(), F.col(vec_id), F.size(vector)))).first()
    return 0 if row[0] is None else row[0][2]


def as_matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(-1, size)

"""Vectors of numbers as integers: rows with a null or a number that isn't finite are left out, the others scaled and floored."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squared lengths stay below this, so that every inner product fits a long.
MOST_SQUARES = 1 << 62


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, __v): the rows whose vector is an array of finite numbers; an empty array is one."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).alias("vec_id"), vector.alias("__v")).where(F.col("__v").isNotNull() & good)


def longest(rows: DataFrame) -> tuple[int, int]:
    """How many rows there are, and how many numbers the longest vector has; one pass."""
    n, dims = rows.agg(F.count("*"), F.max(F.size("__v"))).first()
    return n, dims or 0


def scaled(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch's vectors, as doubles without a fraction; shorter vectors end in zeros."""
    out = np.zeros((len(column), dims))
    flat = np.floor(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out

"""Helpers of the operators on embeddings: which rows take part, and Arrow lists as integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vector: str) -> Column:
    """True for a vector without null, NaN or infinite components; false for a null vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def floored(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of the list column as an int64 matrix of ``width`` columns; shorter vectors end in zeros.

    The product is taken in double precision; a component beyond 2**62 has no integer here and is an error.
    """
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() > 2.0**62:
        raise ValueError("a vector component is too large for 64-bit integers")
    if len(sizes) and (sizes == width).all():
        return flat.astype(np.int64).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact(values: np.ndarray, bits: int) -> np.ndarray:
    """The matrix as it is if its magnitudes stay within ``bits`` bits, else as Python integers."""
    return values if not values.size or int(np.abs(values).max()) < 1 << bits else values.astype(object)

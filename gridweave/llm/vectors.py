"""Vectors as Arrow columns: parsing, validity, and grouping of copies. Shared by the two searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(vec_id long, v array<float or double>, as given) without vectors that are null, empty, or hold null or non-finite components.

    ``nonzero`` also leaves out vectors of zeros. Rows with null ids take no part: they can't be named in a result.
    """
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad")).where("vec_id is not null and v is not null and size(v) > 0 and not bad")
    if nonzero:
        out = out.where(F.exists("v", lambda x: x != 0))
    return out.select("vec_id", "v")


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """The rows of a list column of one length as a matrix, without Python objects. Other lengths among them are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype)
    values = np.asarray(column.flatten())
    if len(pc.list_value_length(column).unique()) != 1:
        raise ValueError("vectors of different lengths")
    return values.reshape(len(column), -1).astype(dtype, copy=False)


def by_length(column: pa.Array) -> list[np.ndarray]:
    """The rows of each length of a list column."""
    lengths = np.asarray(pc.list_value_length(column))
    return [np.flatnonzero(lengths == n) for n in np.unique(lengths)]


def distinct_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, vh, v), vh a hash of v: rows that are equal in id and vector count once, other rows of an id stay."""
    return vectors.withColumn("vh", F.xxhash64("v")).dropDuplicates(["vec_id", "vh"]).select("vec_id", "vh", "v")

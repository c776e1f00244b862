"""What the vector operators share: which vectors take part, and their Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero (an empty vector is all zero)."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(row, id, v, dim) of the usable vectors, in double precision; `row` tells rows apart.

    `row` stays the same only once the result is written.
    """
    v = F.col(vector_column).cast("array<double>")
    return (
        df.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).cast("long").alias("id"),
            v.alias("v"),
        )
        .where(usable(F.col("v")))
        .withColumn("dim", F.size("v"))
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([p.flatten().to_numpy().reshape(len(p), -1) for p in parts if len(p)])

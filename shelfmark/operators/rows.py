"""Row-level operators: keep the latest row per key, drop rows and columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNORDERABLE = (T.MapType, T.VariantType)


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, _UNORDERABLE):
        return False
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype)
    return True


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "extracted_at",
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """The row with the greatest `order` per key; nulls of `order` are oldest.

    Null is a key like any other. Rows that tie on `order` are ranked by `ties`, by default by
    every other column, so that the choice never hangs on file or task order. Spark keeps
    one row per key and task before the shuffle, so a hot key costs one row per task.
    """
    if ties is None:
        used = {*keys, order}
        ties = [f.name for f in df.schema if f.name not in used and _orderable(f.dataType)]
    ranking = Window.partitionBy(*keys).orderBy(
        *(F.col(c).desc_nulls_last() for c in [order, *ties])
    )
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(ranking)).where(F.col(rank) == 1).drop(rank)


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def drop_if_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def stamp_run(df: DataFrame, run: str) -> DataFrame:
    """Add the run stamp, one literal for the whole run."""
    return df.withColumn("extracted_at", F.lit(run))


def distinct_work_list(listing: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct non-null ids, as integers."""
    return (
        listing.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("product_id"))
        .distinct()
    )


def row_audit(entities: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Rows in, rows kept and rows dropped per entity, each from one pass over its raw rows.

    `entities` maps a name to (raw rows, dedupe keys, columns that must not be null). Latest-per-key
    keeps one row per distinct key, so counting keys is enough; the wide rows are never sorted.
    """
    out = None
    for name, (raw, keys, required) in entities.items():
        complete: Column = F.lit(True)
        for column in required:
            complete = complete & F.col(column).isNotNull()
        per_key = raw.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.max(complete).alias("kept")
        )
        one = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
            F.count_if("kept").alias("rows_out"),
        ).select(
            F.lit(name).alias("entity"),
            "rows_in",
            "rows_out",
            (F.col("rows_in") - F.col("rows_out")).alias("dropped"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no entity to audit")
    return out

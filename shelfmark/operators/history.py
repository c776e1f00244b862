"""Slowly changing history (type 2), either run by run or over all runs at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import run_timestamp
from shelfmark.operators.rows import latest_per_key

VALID_FROM = "valid_from"
VALID_TO = "valid_to"


def _differs(left: str, right: str, check_cols: Sequence[str]) -> Column:
    parts = [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in check_cols]
    return reduce(lambda a, b: a | b, parts)


def _assert_one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """Fail the job on the second row of a key. The join below reuses this partitioning."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    message = F.concat(F.lit(f"more than one row for {key} "), F.col(key).cast("string"))
    checked = F.when(F.col("__nth") == 1, F.lit(True)).otherwise(F.raise_error(message))
    return df.withColumn("__nth", nth).where(checked.cast("boolean")).drop("__nth")


def scd2_step(
    open_rows: DataFrame,
    source: DataFrame,
    key: str,
    check_cols: Sequence[str],
    now: Column,
    invalidate_missing: bool = True,
) -> DataFrame:
    """The open rows after one run, together with the rows this run closes.

    One full outer join by key yields at most two rows per key: the old one (kept or closed) and
    the new one. `source` must hold one row per key; the job fails otherwise.
    """
    columns = source.columns
    # The join keys stay plain columns, so the partitioning of the uniqueness check is reused.
    old = open_rows.select(F.col(key).alias("__o"), F.struct(*columns, VALID_FROM).alias("o"))
    new = _assert_one_row_per_key(source, key).select(
        F.col(key).alias("__s"), F.struct(*columns).alias("s")
    )
    both = old.join(new, F.col("__o") == F.col("__s"), "full_outer")

    gone = F.col("s").isNull() & F.lit(invalidate_missing)
    changed = F.col("o").isNotNull() & F.col("s").isNotNull() & _differs("o", "s", check_cols)
    open_end = F.lit(None).cast("timestamp")
    end = F.when(gone | changed, now).otherwise(open_end)
    old_row = F.when(
        F.col("o").isNotNull(),
        F.struct(
            *(F.col(f"o.{c}").alias(c) for c in columns),
            F.col(f"o.{VALID_FROM}").alias(VALID_FROM),
            end.alias(VALID_TO),
        ),
    )
    new_row = F.when(
        F.col("s").isNotNull() & (F.col("o").isNull() | changed),
        F.struct(
            *(F.col(f"s.{c}").alias(c) for c in columns),
            now.alias(VALID_FROM),
            open_end.alias(VALID_TO),
        ),
    )
    return both.select(F.inline_outer(F.array_compact(F.array(old_row, new_row))))


def scd2_merge(
    history: DataFrame,
    source: DataFrame,
    key: str,
    check_cols: Sequence[str],
    now: Column,
    invalidate_missing: bool = True,
) -> DataFrame:
    """The whole history after one run. Closed rows pass through; they are never joined."""
    open_rows = history.where(F.col(VALID_TO).isNull())
    closed = history.where(F.col(VALID_TO).isNotNull())
    step = scd2_step(open_rows, source, key, check_cols, now, invalidate_missing)
    return closed.unionByName(step)


def empty_history(source: DataFrame) -> DataFrame:
    """A history without rows, shaped for `source`."""
    none = F.lit(None).cast("timestamp")
    return source.withColumns({VALID_FROM: none, VALID_TO: none}).where(F.lit(False))


def scd2_backfill(
    df: DataFrame,
    key: str,
    check_cols: Sequence[str],
    run: str = "extracted_at",
    ties: Sequence[str] | None = None,
    runs: Sequence[str] | None = None,
) -> DataFrame:
    """The history that merging every run in turn would give, without a loop over the runs.

    Rows of a key are cut to one per run first, so no window holds more rows than there are
    runs. A new interval starts where a check column differs from the previous run's row or the
    key was missing in the run before; it ends at the first run that is different or lacks the key.
    Pass `runs` when the run stamps are known (bronze has a folder per run) to save a pass.
    """
    states = latest_per_key(df, [key, run], order=run, ties=ties)
    known = states.join(_run_calendar(df, run, runs), run)

    by_run = Window.partitionBy(key).orderBy(run)
    here = F.struct(*(F.col(c) for c in check_cols))
    in_run_before = F.lag("__next").over(by_run) == F.col(run)
    same_as_before = in_run_before & here.eqNullSafe(F.lag(here).over(by_run))
    marked = known.withColumn("__starts", ~F.coalesce(same_as_before, F.lit(False)))
    upto_here = by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Grouping by (key, island) stays inside the partitioning by key: no further shuffle.
    intervals = (
        marked.withColumn("__island", F.count_if("__starts").over(upto_here))
        .groupBy(key, "__island")
        .agg(
            F.min_by(F.struct(*df.columns), run).alias("first"),
            F.max_by("__next", run).alias("end"),
        )
    )
    return intervals.select(
        *(f"first.{c}" for c in df.columns),
        run_timestamp(F.col(f"first.{run}")).alias(VALID_FROM),
        run_timestamp(F.col("end")).alias(VALID_TO),
    )


def _run_calendar(df: DataFrame, run: str, runs: Sequence[str] | None) -> DataFrame:
    """Every run and the run that follows; null after the last.

    All stamps are one sorted array, about 15 bytes a run, made by partial aggregation: nothing is
    collected and no window runs over all runs. The array is paired with itself one place on, and the
    pairs are dealt out without it. Spark broadcasts the calendar where its size allows.
    """
    if runs is None:
        stamps = df.agg(F.array_sort(F.collect_set(run)).alias("r"))
    else:
        known = F.array(*map(F.lit, sorted(set(runs)))).cast("array<string>")
        stamps = df.sparkSession.range(1).select(known.alias("r"))
    pairs = F.arrays_zip("r", F.slice("r", 2, F.size("r")))
    return stamps.select(F.inline(pairs).alias(run, "__next"))


def price_history(history: DataFrame, now: Column) -> DataFrame:
    """Validity of every price; an open one lasts until `now`. Days are date boundaries crossed."""
    end = F.coalesce(F.col(VALID_TO), now)
    return history.select(
        "product_id",
        "name",
        "brand_name",
        "price",
        "discount_rate",
        VALID_FROM,
        end.alias(VALID_TO),
        F.col(VALID_TO).isNull().alias("is_current"),
        F.datediff(end, F.col(VALID_FROM)).cast("bigint").alias("days_at_price"),
    )

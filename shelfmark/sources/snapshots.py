"""A history table whose closed rows are written once and never again.

    <location>/run=<stamp>/state=open      every open row after that run
    <location>/run=<stamp>/state=closed    the rows that run closed

The history as of a run is its open rows and the closed rows of all runs up to it. One view says
which run counts; switching it is the commit, so readers never see half a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import run_timestamp
from shelfmark.operators import history
from shelfmark.sources.bronze import RUN, run_folders
from shelfmark.sources import tables
from shelfmark.sources.tables import create_database

_STATE = "state"


def committed_run(spark: SparkSession, name: str) -> str | None:
    """The run the view `name` shows; None before the first."""
    if not spark.catalog.tableExists(name):
        return None
    shown = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == RUN).first()
    return shown["value"]


def _all_runs(spark: SparkSession, name: str, location: str) -> str:
    """A table over the files of all runs, whose schema has every column that any run has."""
    table = tables.new_version(name)
    spark.catalog.createTable(table, path=location, source="parquet", mergeSchema="true")
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return table


def _left_over_runs(
    spark: SparkSession, location: str, committed: str | None, run: str
) -> list[str]:
    """Folders of runs that were written but never committed."""
    return [
        r
        for r in run_folders(spark, location)
        if r != run and (committed is None or r > committed)
    ]


def snapshot(
    name: str,
    source: DataFrame,
    location: str,
    run: str,
    key: str,
    check_cols: Sequence[str],
    invalidate_missing: bool = True,
) -> DataFrame:
    """Record `source` as of `run` in the history `name` and return the whole history.

    Writes only the open rows and the rows closed now. A run that failed half-way can be repeated
    under its own or a later stamp; a run that is already committed changes nothing.
    """
    spark = source.sparkSession
    create_database(spark, name, location)
    committed = committed_run(spark, name)
    if committed is not None and run <= committed:
        return spark.table(name)
    open_rows = history.empty_history(source)
    earlier = run_folders(spark, location) if committed is not None else []
    if committed is not None:
        # A column that is new in this run is null in the rows before it, one that is gone stays.
        written = spark.read.option("mergeSchema", "true").parquet(location)
        still_open = (F.col(RUN) == committed) & (F.col(_STATE) == "open")
        old = written.where(still_open).drop(RUN, _STATE)
        open_rows = open_rows.unionByName(old, allowMissingColumns=True)
        gone = [c for c in open_rows.columns if c not in source.columns]
        source = source.withColumns(
            {
                c: F.lit(None).cast(open_rows.schema[c].dataType)
                for c in gone
                if c not in (history.VALID_FROM, history.VALID_TO)
            }
        )
    for left_over in _left_over_runs(spark, location, committed, run):
        for state in ("open", "closed"):
            folder = f"{location}/{RUN}={left_over}/{_STATE}={state}"
            open_rows.limit(0).write.mode("overwrite").parquet(folder)

    now = run_timestamp(F.lit(run))
    step = history.scd2_step(open_rows, source, key, check_cols, now, invalidate_missing)
    state = F.when(F.col(history.VALID_TO).isNull(), "open").otherwise("closed")
    step.withColumn(_STATE, state).write.mode("overwrite").partitionBy(_STATE).parquet(
        f"{location}/{RUN}={run}"
    )
    columns = ", ".join(f"`{c}`" for c in step.columns)
    shown = _all_runs(spark, name, location)
    spark.sql(f"""
        CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{RUN}' = '{run}') AS
        SELECT {columns} FROM {shown}
        WHERE ({_STATE} = 'closed' AND {RUN} <= '{run}') OR ({_STATE} = 'open' AND {RUN} = '{run}')
    """)
    # The files stay; only the tables over them go.
    for old in [t for t in tables.versions(spark, name) if t.lower() != shown.lower()][:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    # Nobody reads the open rows of the run before the previous one any more.
    past = [r for r in earlier if r < committed]
    if past:
        step.limit(0).write.mode("overwrite").parquet(f"{location}/{RUN}={past[-1]}/{_STATE}=open")
    return spark.table(name)

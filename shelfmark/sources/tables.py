"""Silver and gold tables: each write makes a new version, then a view is switched to it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from shelfmark.session import scratch_path

# Versions that stay after a write: the current one, and the one that running readers may hold.
KEPT_VERSIONS = 2

# Compressed files of this size are a few times as large in memory.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def create_database(spark: SparkSession, name: str, location: str) -> str:
    """Make sure the database of the table `name` exists below `location`; return its name."""
    database, _, table = name.rpartition(".")
    if not database or not table:
        raise ValueError(f"a table needs a database: {name}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}/{database}'")
    return database


def new_version(name: str) -> str:
    """A name that sorts after all earlier versions."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")
    return f"{name}__{stamp}_{uuid.uuid4().hex[:8]}"


# What `new_version` puts behind a name: a time to the microsecond and eight hex digits.
_VERSION = r"__\d{20}_[0-9a-f]{8}"


def versions(spark: SparkSession, name: str) -> list[str]:
    """The stored versions of exactly this table, oldest first.

    Other tables whose names begin alike (`books__raw` beside `books`) are none of them.
    """
    database, _, table = name.rpartition(".")
    found = spark.sql(f"SHOW TABLES IN {database} LIKE '{table}__*'").select("tableName")
    own = re.compile(re.escape(table) + _VERSION, re.IGNORECASE)
    return sorted(f"{database}.{row[0]}" for row in found.collect() if own.fullmatch(row[0]))


def write_table(
    df: DataFrame,
    name: str,
    location: str,
    buckets: tuple[int, str] | None = None,
    keep: int = KEPT_VERSIONS,
    options: Mapping[str, str] | None = None,
) -> None:
    """Replace the table `name`. Readers see the old rows until the new ones are complete.

    The rows may come from the table itself: the old version is not touched. `buckets` (number,
    column) stores the rows hash-partitioned in one file per bucket, so that joins on the column
    need no shuffle. Use it for columns without hot values: a bucket is never split. `options` go to
    the Parquet writer.
    """
    spark = df.sparkSession
    create_database(spark, name, location)
    version = new_version(name)
    if buckets is None:
        writer = df.write.format("parquet")
    else:
        number, column = buckets
        by_bucket = df.repartition(number, column)
        writer = by_bucket.write.format("parquet").bucketBy(number, column).sortBy(column)
    writer.options(**(options or {})).saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    older = [old for old in versions(spark, name) if old.lower() != version.lower()]
    for old in older[: max(0, len(older) - (keep - 1))]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")


def write_tables(spark: SparkSession, tables: Mapping[str, DataFrame], location: str) -> DataFrame:
    """Replace every table and count what was written: (table, rows)."""
    for name, df in tables.items():
        write_table(df, name, location)
    counts = None
    for name in tables:
        one = spark.table(name).agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def publish_views(views: Mapping[str, DataFrame]) -> None:
    """Staging models are views: nothing is stored."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def materialize(
    df: DataFrame, name: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """Write `df` once into the shared folder and read it back, for rows that feed many plans."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(dfs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """`materialize` of several tables that do not need each other, at the same time.

    So the last tasks of one write do not leave the cluster idle before the next begins.
    """
    if not dfs:
        return {}
    write = inheritable_thread_target(materialize)
    with ThreadPoolExecutor(len(dfs)) as threads:
        running = {name: threads.submit(write, df, name) for name, df in dfs.items()}
        return {name: one.result() for name, one in running.items()}


def small_side(df: DataFrame, name: str, max_rows: int) -> DataFrame:
    """The one-row-per-key side of a join, written once; rows and bytes are those of its files.

    Up to `max_rows` rows and `MAX_BROADCAST_BYTES` of files it is broadcast, so the other side needs
    no shuffle. Beyond either it is a plain table: both sides are then shuffled straight into the
    join, which is the shape in which a hot key of the other side is split at run time.
    """
    written = materialize(df, name)
    small = written.count() <= max_rows and file_bytes(written) <= MAX_BROADCAST_BYTES
    return F.broadcast(written) if small else written


def file_bytes(df: DataFrame) -> int:
    """The size of the files behind a table, as Spark's planner sees it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

"""Latest row per key, kept up to date as runs arrive.

Reading all of bronze again for every run costs more each day. The latest rows so far and the new
files are enough: latest-per-key of a union is latest-per-key of the latest rows of its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.rows import latest_per_key
from shelfmark.sources.bronze import RUN, run_folders


def _stamp(batch: int) -> str:
    return f"{batch:012d}"


def latest_state(spark: SparkSession, state_path: str, schema: T.StructType) -> DataFrame:
    """The latest row per key after the last finished batch; empty before the first."""
    batches = run_folders(spark, state_path)
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state_path}/{RUN}={batches[-1]}")


def follow_latest(
    spark: SparkSession,
    bronze_path: str,
    schema: T.StructType,
    state_path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: str = "extracted_at",
    ties: Sequence[str] | None = None,
) -> StreamingQuery:
    """Fold all files that are new since the last call into the state, then stop.

    Every batch writes the state into a folder of its own number, from the folder before it, so a
    batch that is repeated after a failure gives the same folder again.
    """
    arrivals = spark.readStream.schema(schema).parquet(bronze_path)

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = [b for b in run_folders(session, state_path) if b < _stamp(number)]
        rows = batch.select(*schema.fieldNames())
        if known:
            rows = rows.unionByName(
                session.read.schema(schema).parquet(f"{state_path}/{RUN}={known[-1]}")
            )
        latest_per_key(rows, keys, order, ties).write.mode("overwrite").parquet(
            f"{state_path}/{RUN}={_stamp(number)}"
        )

    return (
        arrivals.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

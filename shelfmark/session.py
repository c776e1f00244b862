"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Results depend on these: text without a zone is UTC, bad casts are explicit (try_*), and of a key
# that an object repeats the last value counts.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# A hot key is split at run time instead of landing in one task. `forceOptimizeSkewedJoin`
# splits even where the split costs one more shuffle downstream.
SKEW = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# A method beyond 8,000 bytes is never compiled by the JVM: conversions of many columns at once are
# generated in pieces instead. Scans are cut small, so that a task's rows do not grow with the tables.
TASKS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.files.maxPartitionBytes": str(8 * 1024 * 1024),
}

TARGET_PARTITION_BYTES = 200 * 1024 * 1024
MAX_SHUFFLE_PARTITIONS = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Set what correctness, skew handling and bounded tasks need; leaves sizing of shuffles to the caller."""
    for key, value in {**SEMANTICS, **SKEW, **TASKS}.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Raise the initial shuffle partition count so one partition holds about 200 MB.

    AQE merges small partitions again, so the number is an upper start, not a target. Never
    goes below what the session has.
    """
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MAX_SHUFFLE_PARTITIONS, math.ceil(input_bytes / TARGET_PARTITION_BYTES))
    chosen = max(current, wanted)
    spark.conf.set("spark.sql.shuffle.partitions", str(chosen))
    return chosen


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    # local[...] is one machine; local-cluster[...] has executors with folders of their own.
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="shelfmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Folders of the jobs that are running, innermost last.
_job_folders: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing else ever writes there."""
    folder = _job_folders[-1] if _job_folders else shared_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Everything that `scratch_path` names inside is removed when the job ends, well or not.

    For jobs that write their results before they end; a lazy result would miss its files.
    """
    folder = f"{shared_folder(spark)}/job-{uuid.uuid4().hex[:12]}"
    _job_folders.append(folder)
    try:
        yield folder
    finally:
        _job_folders.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

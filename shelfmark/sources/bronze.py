"""Bronze: append-only Parquet, one folder (or one file) per run."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.sources.footers import FileGroup, file_groups

RUN = "run"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_NUMERIC = (*_INTEGRAL, *_FLOATING)
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every Parquet file below `path`; the content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        return reader.option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length bigint")


def input_bytes(spark: SparkSession, path: str) -> int:
    return _files(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def bronze_append(df: DataFrame, path: str, run: str) -> None:
    """Write one run into its own folder. Other runs stay untouched; a retried run replaces itself.

    So the checkpoint files of a run need stamps of their own.
    """
    df.write.mode("overwrite").parquet(f"{path}/{RUN}={run}")


def run_folders(spark: SparkSession, path: str) -> list[str]:
    """The run stamps below `path`, oldest first."""
    run = F.regexp_extract("path", rf"/{RUN}=([^/]+)/", 1).alias("run")
    found = _files(spark, path).select(run).where(F.col("run") != "").distinct()
    return sorted(row["run"] for row in found.collect())


def latest_run_file(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the newest run (greatest run folder, else greatest file name); None without files.

    Only the newest run is opened.
    """
    folder = F.regexp_extract("path", rf"/{RUN}=([^/]+)/", 1)
    name = F.element_at(F.split("path", "/"), -1)
    newest = _files(spark, path).agg(
        F.max(F.when(folder != "", folder)).alias("run"),
        F.max_by("path", F.when(folder == "", name)).alias("file"),
    )
    found = newest.first()
    if found["run"] is not None:
        return spark.read.parquet(f"{path}/{RUN}={found['run']}")
    if found["file"] is not None:
        return spark.read.parquet(found["file"])
    return None


def bronze_union(spark: SparkSession, path: str, keep_run: bool = False) -> DataFrame:
    """All runs below `path`, appended by column name; a column a file lacks is null there.

    The footers of all files are read once, in tasks. Files whose shared columns agree are one scan;
    where they do not (a whole-number column with gaps comes as double), there is a scan for each
    group that agrees, in whatever order the files lie, and columns are cast to the widest type.
    Columns that are whole numbers in some files and whole doubles in all others stay whole numbers,
    so ids keep their last digit.
    """
    files = _files(spark, path)
    groups = file_groups(files)
    if groups is not None:
        if not groups:
            raise FileNotFoundError(f"no Parquet file below {path}")
        merged = _widened(_scans(spark, path, groups))
    elif not files.take(1):
        raise FileNotFoundError(f"no Parquet file below {path}")
    else:
        merged = _union_by_halves(spark, path)
    return merged if keep_run else merged.drop(RUN)


def _scans(spark: SparkSession, path: str, groups: list[FileGroup]) -> list[DataFrame]:
    """One scan per group, with the schema of its examples; columns without a type of their own go."""
    parts = []
    for group in groups:
        merging = spark.read.option("basePath", path).option("mergeSchema", "true")
        schema = merging.parquet(*group.examples).schema
        kept = [
            T.StructField(f.name, T.StringType()) if f.name == RUN and f.name not in group.columns else f
            for f in schema
        ]
        reader = spark.read.option("basePath", path).schema(T.StructType(kept))
        part = reader.parquet(*group.files)
        others = set().union(*(g.typed for g in groups if g is not group))
        parts.append(part.drop(*(group.empty & others)))
    return parts


def _union_by_halves(spark: SparkSession, path: str) -> DataFrame:
    """For files that only Spark's readers can open: merged, or cut into stretches that merge."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except Exception as error:  # raised by the footer job, so it has no class of its own
        if "CANNOT_MERGE" not in str(error):
            raise
    return _widened(_stretches(spark, path))


def _agreeing(read, places: list[str]) -> list[DataFrame]:
    """`places` in order, cut into as few stretches as halving finds whose files merge.

    Writers change now and then, not from file to file: the number of schema reads follows the
    number of changes, and every read is one job over the footers of its stretch.
    """
    try:
        return [read(places)]
    except Exception as error:  # raised by the footer job, so it has no class of its own
        if "CANNOT_MERGE" not in str(error) or len(places) == 1:
            raise
    half = len(places) // 2
    return _agreeing(read, places[:half]) + _agreeing(read, places[half:])


def _stretches(spark: SparkSession, path: str) -> list[DataFrame]:
    reader = spark.read.option("basePath", path).option("mergeSchema", "true")
    runs = run_folders(spark, path)
    # The files of a run were written by one job; without run folders, files stand for runs.
    places = [f"{path}/{RUN}={run}" for run in runs]
    if not places:
        places = sorted(r["path"] for r in _files(spark, path).select("path").collect())
    parts = _agreeing(lambda some: reader.parquet(*some), places)
    # Stretches that halving cut apart although they agree are read together again.
    same: dict[str, list[DataFrame]] = {}
    for part in parts:
        same.setdefault(part.schema.json(), []).append(part)
    parts = [reduce(DataFrame.unionByName, some) for some in same.values()]
    return [_drop_untyped(part, parts) for part in parts]


def _widened(parts: list[DataFrame]) -> DataFrame:
    """All parts by column name, each column as the widest of its types."""
    if len(parts) == 1:
        return parts[0]
    types: dict[str, list[T.DataType]] = {}
    for part in parts:
        for f in part.schema:
            types.setdefault(f.name, []).append(f.dataType)
    whole = _whole_doubles(parts, types)
    wide = {
        name: widest([T.LongType() if name in whole and isinstance(t, _FLOATING) else t for t in seen])
        for name, seen in types.items()
    }
    cast = [part.select(*(_widen(f, wide[f.name]) for f in part.schema)) for part in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def _whole_doubles(parts: list[DataFrame], types: dict[str, list[T.DataType]]) -> set[str]:
    """Columns that are whole numbers in some parts and doubles without fractions in others.

    Looks only at the double columns in question, one pass per part that has some.
    """
    mixed = {
        name
        for name, seen in types.items()
        if any(isinstance(t, _INTEGRAL) for t in seen) and any(isinstance(t, _FLOATING) for t in seen)
    }
    for part in parts:
        doubles = [f.name for f in part.schema if f.name in mixed and isinstance(f.dataType, _FLOATING)]
        if doubles:
            # Counted in passing, so nothing is exchanged.
            seen = Observation()
            wrong = [F.count_if(~_is_whole(F.col(f"`{c}`"))).alias(c) for c in doubles]
            part.observe(seen, *wrong).select(*(F.col(f"`{c}`") for c in doubles)).write.format("noop").mode("overwrite").save()
            mixed -= {c for c in doubles if seen.get[c]}
    return mixed


def _is_whole(col: Column) -> Column:
    """A double that a bigint holds to the last digit."""
    return (F.abs(col) <= F.lit(float(1 << 53))) & (col == F.floor(col))


def _drop_untyped(part: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Drop columns that hold no value in `part` and read as int only for want of a type.

    Writers store a column of nothing but nulls without a type, which reads back as int. Only such
    columns that another file gives a non-numeric type are looked at.
    """
    suspects = [
        f.name
        for f in part.schema
        if isinstance(f.dataType, T.IntegerType)
        and any(
            f.name in other.columns and not isinstance(other.schema[f.name].dataType, _NUMERIC)
            for other in parts
        )
    ]
    if not suspects:
        return part
    counts = part.agg(*(F.count(F.col(c)).alias(c) for c in suspects)).first()
    return part.drop(*(c for c in suspects if counts[c] == 0))


def widest(seen: list[T.DataType]) -> T.DataType:
    """One type that holds the values of all."""
    first = seen[0]
    if all(t == first for t in seen):
        return first
    if all(isinstance(t, _INTEGRAL) for t in seen):
        return T.LongType()
    if all(isinstance(t, _NUMERIC) for t in seen):
        return T.DoubleType()
    return T.StringType()


def _widen(f: T.StructField, target: T.DataType) -> Column:
    col = F.col(f"`{f.name}`")
    if f.dataType == target:
        return col
    if isinstance(f.dataType, _NESTED):
        return F.to_json(col, {"ignoreNullFields": "false"}).alias(f.name)
    if isinstance(f.dataType, _FLOATING) and isinstance(target, T.StringType):
        # 123.0 and 123 are one id.
        whole = F.when(_is_whole(col), col.cast("bigint").cast("string"))
        return F.coalesce(whole, col.cast("string")).alias(f.name)
    return col.cast(target).alias(f.name)


def nested_to_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, null fields kept; scalar columns as they are."""
    nested = (*_NESTED, T.VariantType)
    return df.withColumns(
        {
            f.name: F.to_json(F.col(f"`{f.name}`"), {"ignoreNullFields": "false"})
            for f in df.schema
            if isinstance(f.dataType, nested)
        }
    )

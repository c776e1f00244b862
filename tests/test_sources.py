import json
import uuid

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.sources import bronze, fixtures, footers, snapshots, tables


def test_union_of_agreeing_runs(spark, tmp_path):
    path = str(tmp_path / "b")
    bronze.bronze_append(spark.range(2), path, "20240101_000000")
    more = spark.range(2, 4).withColumn("extra", F.lit("x"))
    bronze.bronze_append(more, path, "20240102_000000")
    found = bronze.bronze_union(spark, path)
    assert sorted(map(tuple, found.collect())) == [(0, None), (1, None), (2, "x"), (3, "x")]
    runs = bronze.bronze_union(spark, path, keep_run=True).select("run").distinct().collect()
    assert {r["run"] for r in runs} == {"20240101_000000", "20240102_000000"}


def test_union_of_drifting_files(spark, tmp_path):
    """A gap turns whole numbers into doubles; an empty column has no type of its own."""
    pd.DataFrame({"id": [1, 2], "flag": [None, None], "a": ["x", "y"], "m": [1, 2]}).to_parquet(
        tmp_path / "l_1.parquet"
    )
    pd.DataFrame({"id": [3.0, None], "flag": [True, False], "b": [1, 2], "m": ["q", "r"]}).to_parquet(
        tmp_path / "l_2.parquet"
    )
    found = bronze.bronze_union(spark, str(tmp_path))
    types = {f.name: f.dataType.simpleString() for f in found.schema}
    assert types == {"id": "bigint", "flag": "boolean", "a": "string", "m": "string", "b": "bigint"}
    by_m = {r["m"]: r for r in found.collect()}
    assert (by_m["1"]["id"], by_m["1"]["flag"], by_m["1"]["a"], by_m["1"]["b"]) == (1.0, None, "x", None)
    assert (by_m["q"]["id"], by_m["q"]["flag"], by_m["q"]["a"], by_m["q"]["b"]) == (3.0, True, None, 1)
    assert by_m["r"]["id"] is None


def test_union_keeps_run_with_drift(spark, tmp_path):
    path = str(tmp_path / "b")
    bronze.bronze_append(spark.range(1), path, "20240101_000000")
    as_struct = spark.range(1).select(F.struct("id").alias("id"))
    bronze.bronze_append(as_struct, path, "20240102_000000")
    found = bronze.bronze_union(spark, path, keep_run=True).orderBy("run").collect()
    assert [(r["run"], r["id"]) for r in found] == [
        ("20240101_000000", "0"),
        ("20240102_000000", '{"id":0}'),
    ]


def test_union_of_nothing_is_an_error(spark, tmp_path):
    for path in (tmp_path, tmp_path / "missing"):
        with pytest.raises(FileNotFoundError):
            bronze.bronze_union(spark, str(path))


def test_append_leaves_other_runs_and_replaces_a_retry(spark, tmp_path):
    path = str(tmp_path / "b")
    bronze.bronze_append(spark.range(3), path, "20240101_000000")
    bronze.bronze_append(spark.range(5), path, "20240102_000000")
    bronze.bronze_append(spark.range(4), path, "20240102_000000")
    assert bronze.bronze_union(spark, path).count() == 7
    assert bronze.run_folders(spark, path) == ["20240101_000000", "20240102_000000"]
    assert bronze.input_bytes(spark, path) > 0


def test_latest_run(spark, tmp_path):
    assert bronze.latest_run_file(spark, str(tmp_path / "none")) is None
    path = str(tmp_path / "runs")
    for run, n in {"20240101_000000": 3, "20240103_000000": 5, "20240102_000000": 4}.items():
        bronze.bronze_append(spark.range(n), path, run)
    assert bronze.latest_run_file(spark, path).count() == 5
    for stamp, n in {"20240101_000000": 1, "20240102_000000": 2}.items():
        pd.DataFrame({"id": range(n)}).to_parquet(tmp_path / f"listing_{stamp}.parquet")
    flat = tmp_path / "flat"
    flat.mkdir()
    for stamp, n in {"20240101_000000": 1, "20240102_000000": 2}.items():
        pd.DataFrame({"id": range(n)}).to_parquet(flat / f"listing_{stamp}.parquet")
    assert bronze.latest_run_file(spark, str(flat)).count() == 2


def test_nested_to_json(spark):
    df = spark.createDataFrame(
        [(1, ("a", None), [1, 2], {"k": 5}), (2, None, None, None)],
        "id bigint, s struct<x:string,y:int>, l array<int>, m map<string,int>",
    ).withColumn("v", F.try_parse_json(F.lit('{"z":[1]}')))
    one, two = bronze.nested_to_json(df).orderBy("id").collect()
    assert json.loads(one["s"]) == {"x": "a", "y": None}
    assert (json.loads(one["l"]), json.loads(one["m"]), json.loads(one["v"])) == (
        [1, 2],
        {"k": 5},
        {"z": [1]},
    )
    assert (two["id"], two["s"], two["l"]) == (2, None, None)


def test_table_can_be_replaced_from_itself(spark, tmp_path):
    location = str(tmp_path)
    tables.write_table(spark.range(3), "demo.numbers", location)
    tables.write_table(
        spark.table("demo.numbers").withColumn("id", F.col("id") + 10), "demo.numbers", location
    )
    assert sorted(r["id"] for r in spark.table("demo.numbers").collect()) == [10, 11, 12]


def test_old_versions_go(spark, tmp_path):
    for n in range(1, 5):
        tables.write_table(spark.range(n), "kept.numbers", str(tmp_path))
        tables.write_table(spark.range(9), "kept.numbers_too", str(tmp_path))
    assert len(tables.versions(spark, "kept.numbers")) == tables.KEPT_VERSIONS
    assert spark.table("kept.numbers").count() == 4
    assert spark.table("kept.numbers_too").count() == 9
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), "no_database", str(tmp_path))


def test_a_table_never_touches_another(spark, tmp_path):
    """Names that begin alike, also with what separates names and versions."""
    location = str(tmp_path)
    for n in range(1, 4):
        tables.write_table(spark.range(7), "apart.books__raw", location)
        tables.write_table(spark.range(n), "apart.books", location)
    assert spark.table("apart.books").count() == 3 and spark.table("apart.books__raw").count() == 7
    assert len(tables.versions(spark, "apart.books")) == tables.KEPT_VERSIONS
    assert len(tables.versions(spark, "apart.books__raw")) == tables.KEPT_VERSIONS


def test_ids_survive_drift(spark, tmp_path):
    path = str(tmp_path / "b")
    big = [9007199254740993, 9007199254740992]
    bronze.bronze_append(spark.createDataFrame([(i,) for i in big], "id bigint"), path, "20240101_000000")
    bronze.bronze_append(spark.createDataFrame([(5.0,), (None,)], "id double"), path, "20240102_000000")
    found = bronze.bronze_union(spark, path)
    assert found.schema["id"].dataType.simpleString() == "bigint"
    assert {r["id"] for r in found.collect()} == {*big, 5, None}
    bronze.bronze_append(spark.createDataFrame([("5",)], "id string"), path, "20240103_000000")
    assert sorted(r["id"] or "" for r in bronze.bronze_union(spark, path).collect()) == sorted(["", "5", "5", *map(str, big)])


def test_union_reads_few_schemas(spark, tmp_path, monkeypatch):
    """The number of schema reads follows the changes of the schema, not the number of files."""
    for i in range(60):
        kind = pd.Series([i], dtype="int64" if i < 20 else "float64" if i < 40 else "object")
        pd.DataFrame({"id": kind.astype(str) if i >= 40 else kind, "n": [i]}).to_parquet(tmp_path / f"l_{i:03d}.parquet")
    reads = []
    usual = bronze._agreeing
    monkeypatch.setattr(bronze, "_agreeing", lambda read, places: reads.append(len(places)) or usual(read, places))
    found = bronze.bronze_union(spark, str(tmp_path))
    assert found.count() == 60 and {r["id"] for r in found.collect()} == {str(i) for i in range(60)}
    assert len(reads) < 30


def _drifting(folder, n, runs=False):
    """Files of three schemas that take turns: whole numbers, doubles with gaps, text."""
    for i in range(n):
        place = folder / f"run=2024{i:04d}_000000" if runs else folder
        place.mkdir(exist_ok=True, parents=True)
        kind = ["int64", "float64", "object"][i % 3]
        ids = pd.Series([i, None] if i % 3 == 1 else [i, i], dtype="object").astype(str if kind == "object" else kind)
        pd.DataFrame({"id": ids, "n": [i, i]}).to_parquet(place / f"l_{i:04d}.parquet")


def _jobs(spark, action):
    """What `action` returns, and the number of Spark jobs it took."""
    name = f"counted {uuid.uuid4()}"
    spark.sparkContext.setJobGroup(name, "", False)
    try:
        found = action()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _number_of_scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("runs", [False, True])
def test_union_reads_each_schema_once(spark, tmp_path, runs):
    """Neither jobs nor scans follow the number of files, in whatever order schemas change."""
    _drifting(tmp_path, 500, runs)
    spark.range(1).count()
    found, jobs = _jobs(spark, lambda: bronze.bronze_union(spark, str(tmp_path), keep_run=runs))
    assert jobs <= 8 + runs  # folders are listed by a job of their own
    assert _number_of_scans(found) <= 3
    rows = found.collect()
    expected = [x for i in range(500) for x in ([str(i), None] if i % 3 == 1 else [str(i)] * 2)]
    assert sorted((r["id"] for r in rows), key=lambda x: (x is None, x)) == sorted(expected, key=lambda x: (x is None, x))
    if runs:
        assert {r["run"] for r in rows if r["n"] == 7} == {"20240007_000000"}


def test_union_without_reach_for_tasks(spark, tmp_path, monkeypatch):
    """Where only Spark's readers can open the files, halving gives the same rows."""
    _drifting(tmp_path, 12)
    key = lambda r: (r["n"], r["id"] or "")
    expected = sorted(bronze.bronze_union(spark, str(tmp_path)).collect(), key=key)
    monkeypatch.setattr(bronze, "file_groups", lambda files: None)
    assert sorted(bronze.bronze_union(spark, str(tmp_path)).collect(), key=key) == expected


def test_footers_group_files(spark, tmp_path):
    """Missing columns and wider decimals agree; types, nesting and repetition do not."""
    schemas = {
        "a": "id long, s struct<x:int>", "b": "id long, extra string", "c": "id long, s struct<x:int,y:string>",
        "d": "id long, s string", "e": "id long, s array<int>", "f": "id int", "g": "d decimal(10,2)",
        "h": "d decimal(20,2)", "i": "d decimal(20,3)",
    }
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / name))
    groups = footers.file_groups(bronze._files(spark, str(tmp_path)))
    names = [sorted({f.split("/")[-2] for f in g.files}) for g in groups]
    assert len(names) == 4
    by_name = {n: i for i, some in enumerate(names) for n in some}
    assert by_name["a"] == by_name["b"] == by_name["c"] and by_name["g"] == by_name["h"] != by_name["i"]
    assert len({by_name[n] for n in "adef"}) == 4
    missing = spark.createDataFrame([(str(tmp_path / "no.parquet"),)], "path string")
    assert footers.file_groups(missing) is None


def test_run_stamps_stay_text(spark, tmp_path):
    """Stamps that look like numbers in some runs are text in all."""
    for run, kind in {"20240101": "int", "20240102_000000": "string"}.items():
        bronze.bronze_append(spark.range(1).select(F.col("id").cast(kind).alias("id")), str(tmp_path), run)
    found = bronze.bronze_union(spark, str(tmp_path), keep_run=True)
    assert {r["run"] for r in found.collect()} == {"20240101", "20240102_000000"}


def test_scratch_goes_with_the_job(spark):
    import os

    with session.scratch(spark) as folder:
        assert tables.materialize(spark.range(3), "x").count() == 3
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    with pytest.raises(ZeroDivisionError), session.scratch(spark) as folder:
        tables.materialize(spark.range(3), "x")
        raise ZeroDivisionError
    assert not os.path.exists(folder)


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    location = str(tmp_path)
    left = spark.range(100).withColumnRenamed("id", "k").withColumn("l", F.lit(1))
    tables.write_table(left, "demo.left", location, buckets=(4, "k"))
    tables.write_table(left.withColumnRenamed("l", "r"), "demo.right", location, buckets=(4, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("demo.left").join(spark.table("demo.right"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
        # One file per bucket, however many tasks there were.
        assert len(spark.table("demo.left").inputFiles()) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_side_is_broadcast_by_its_size(spark):
    def plan(limit):
        side = tables.small_side(spark.range(10), "side", limit)
        joined = spark.range(1000).join(side, "id")
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(10)
    assert "strategy=broadcast" not in plan(9)


def test_few_but_long_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "MAX_BROADCAST_BYTES", 20_000)
    long = spark.range(10).withColumn("text", F.expr("array_join(transform(sequence(1, 900), x -> uuid()), '')"))
    side = tables.small_side(long, "side", 100)
    assert tables.file_bytes(side) > 20_000
    assert "strategy=broadcast" not in side._jdf.queryExecution().analyzed().toString()


def test_shared_folder_is_never_local_on_a_cluster():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "yarn"})

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        Session.conf["spark.master"] = master
        with pytest.raises(ValueError):
            session.shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert session.shared_folder(Session()) == "hdfs:///shared"
    assert session.scratch_path(Session(), "x").startswith("hdfs:///shared/x-")


def test_write_tables_counts(spark, tmp_path):
    counts = tables.write_tables(
        spark, {"counted.a": spark.range(3), "counted.b": spark.range(0)}, str(tmp_path)
    )
    assert sorted(map(tuple, counts.collect())) == [("counted.a", 3), ("counted.b", 0)]


def test_widest():
    from pyspark.sql import types as T

    assert bronze.widest([T.IntegerType(), T.LongType()]) == T.LongType()
    assert bronze.widest([T.LongType(), T.DoubleType()]) == T.DoubleType()
    assert bronze.widest([T.BooleanType(), T.BooleanType()]) == T.BooleanType()
    assert bronze.widest([T.BooleanType(), T.LongType()]) == T.StringType()


def test_size_shuffles_follows_the_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffles(spark, 10) == int(before)
        assert session.size_shuffles(spark, 100 * 10**12) == 200_000
        assert session.size_shuffles(spark, 10**12) == 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    try:
        assert session.size_shuffles(spark, 10**12) == 4769
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _catalogue(spark, rows):
    return spark.createDataFrame(rows, "product_id bigint, price double, name string")


def _shown(df):
    return sorted(
        (r["product_id"], r["price"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day)
        for r in df.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))
        .withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))
        .collect()
    )


def test_snapshot_runs(spark, tmp_path):
    name, location = "snap.prices", str(tmp_path / "s")

    def record(day, rows):
        return snapshots.snapshot(
            name, _catalogue(spark, rows), location, f"202401{day:02d}_000000", "product_id", ["price"]
        )

    record(1, [(1, 5.0, "a"), (2, 6.0, "b")])
    record(2, [(1, 5.0, "renamed"), (2, 7.0, "b"), (3, 1.0, "c")])
    after = record(3, [(2, 7.0, "b"), (3, 1.0, "c")])
    expected = [(1, 5.0, 1, 3), (2, 6.0, 1, 2), (2, 7.0, 2, None), (3, 1.0, 2, None)]
    assert _shown(after) == expected
    # The same run again, or an older one, changes nothing.
    assert _shown(record(3, [(2, 9.0, "b")])) == expected
    assert snapshots.committed_run(spark, name) == "20240103_000000"
    # A run that was written but never committed leaves no trace in a later one.
    crashed = _catalogue(spark, [(2, 7.5, "b")]).withColumns(
        {"valid_from": F.current_timestamp(), "valid_to": F.current_timestamp()}
    )
    crashed.withColumn("state", F.lit("closed")).write.partitionBy("state").parquet(
        f"{location}/run=20240104_000000"
    )
    assert _shown(spark.table(name)) == expected
    last = record(5, [(1, 5.0, "back"), (2, 7.0, "b"), (3, 1.0, "c")])
    assert _shown(last) == sorted([*expected, (1, 5.0, 5, None)])


def test_snapshots_do_not_grow_and_take_new_columns(spark, tmp_path):
    name, location = "snap.wide", str(tmp_path / "s")
    columns = "product_id bigint, price double"

    def record(day, rows, ddl=columns):
        source = spark.createDataFrame(rows, ddl)
        return snapshots.snapshot(name, source, location, f"202401{day:02d}_000000", "product_id", ["price"])

    rows = [(i, float(i)) for i in range(50)]
    for day in range(1, 9):
        record(day, rows)
    stored = spark.read.parquet(location).where("state = 'open'").groupBy("run").count().collect()
    assert sum(r["count"] for r in stored) <= 100
    wider = [(i, float(i + (i == 3)), "m") for i in range(50)]
    after = record(9, wider, columns + ", maker string")
    assert after.count() == 51 and {r["maker"] for r in after.collect()} == {None, "m"}
    assert [r["maker"] for r in after.where("product_id = 3").orderBy("valid_from").collect()] == [None, "m"]
    last = record(10, rows)
    assert "maker" in last.columns and last.where("valid_to IS NULL").count() == 50


@pytest.mark.parametrize("groups", [1, 4])
def test_rows_of_a_task_do_not_grow_with_the_table(spark, tmp_path, monkeypatch, groups):
    """Row groups too large for a task are dealt out; others are read as they lie, one to a task."""
    monkeypatch.setattr(fixtures, "ROW_GROUP_BYTES", 0)
    monkeypatch.setattr(fixtures, "TASK_ROWS", 1_500)
    lines = pq.read_table("/root/testdata/sf0.001/lineitem.parquet")
    pq.write_table(lines, tmp_path / "lineitem.parquet", row_group_size=-(-len(lines) // groups))
    monkeypatch.setattr(fixtures, "file_bytes", lambda df: 1)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert int(size) <= 16 << 20
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "16k")
    try:
        found = fixtures.table(spark, str(tmp_path), "lineitem")
        tasks = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found.count() == len(lines)
    assert tasks <= 1_600
    assert ("Exchange" in plan) == (groups == 1)


def test_conversions_of_a_response_are_generated_in_pieces(spark):
    """One method for all columns of a listing would be too large for the JVM to compile."""
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000

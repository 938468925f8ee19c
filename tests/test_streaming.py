"""Streams over several files and micro-batches give what their batch forms give."""

import os
import uuid

from pyspark.sql import functions as F

from batchwatch.operators.profile import ColumnRule
from batchwatch.plans import storage as storage_plans
from batchwatch.plans.views import base, view
from batchwatch.sources import sinks
from batchwatch.sources.storage import stored
from batchwatch.streaming import feeds, ingest


def split_stream(spark, tmp_path, df, files=5):
    path = str(tmp_path / uuid.uuid4().hex)
    df.repartition(files).write.parquet(path)
    return feeds.file_stream(spark, path, df, maxFilesPerTrigger=2)


def test_rates_over_micro_batches(spark, sf_dir, tmp_path):
    events = base(spark, sf_dir, "events")
    live = feeds.event_rate(split_stream(spark, tmp_path, events.repartition(1).sortWithinPartitions("ts")), "event_type", F.col("value") > 20)
    table = feeds.stream_to_table(live, str(tmp_path / "w1"), "complete")
    assert table.select("epoch").distinct().count() == 3
    final = feeds.newest_epoch(table, ["minute", "event_type"])
    batch = feeds.event_rate(events, "event_type", F.col("value") > 20)
    assert final.exceptAll(batch.select(final.columns)).count() == 0 and final.count() == batch.count()


def test_latest_state_over_micro_batches(spark, sf_dir, tmp_path):
    steps = view(spark, sf_dir, "agent_steps")
    latest = lambda df: feeds.latest_state(df, ["run_id", "step_index"], ["status", "seq"], ["seq"])
    table = feeds.stream_to_table(latest(split_stream(spark, tmp_path, steps)), str(tmp_path / "w2"), "update")
    final = feeds.newest_epoch(table, ["run_id", "step_index"])
    assert final.exceptAll(latest(steps)).count() == 0 and final.count() == latest(steps).count()


def test_live_duplicates(spark, tmp_path):
    rows = [("run_complete", 1, "m", "2024-01-01 00:00:00"), ("run_complete", 1, "m", "2024-01-01 00:01:00"), ("ping", 1, "m", "2024-01-01 00:00:00"), ("run_failed", 2, "", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "event string, run_id int, message string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = feeds.stream_to_table(feeds.dedupe_live(split_stream(spark, tmp_path, df), ["event", "run_id", "message"]), str(tmp_path / "w3"))
    assert sorted(r["event"] for r in out.collect()) == ["run_complete", "run_failed"]


def test_latency_sketch_is_close(spark, sf_dir, tmp_path):
    events = base(spark, sf_dir, "events")
    table = feeds.stream_to_table(feeds.latency_sketch(split_stream(spark, tmp_path, events, 1), "value"), str(tmp_path / "w4"), "complete")
    assert table.agg(F.sum("n")).first()[0] == events.filter("value IS NOT NULL").count()


def test_rerun_replaces_a_micro_batch(spark, tmp_path):
    write = feeds.batch_writer(str(tmp_path / "t"))
    for _ in range(2):
        write(spark.range(5), 0)
    write(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_step_rule(spark):
    steps = spark.createDataFrame([(1, 0, "pending"), (1, 1, "running"), (2, 0, "pending"), (2, 1, "running"), (3, 0, "running")], "run_id int, step_index int, status string")
    ended = spark.createDataFrame([(1, "run_complete"), (2, "run_failed")], "run_id int, event string")
    out = {(r["run_id"], r["step_index"]): r["status"] for r in feeds.close_steps(steps, ended).collect()}
    assert out == {(1, 0): "done", (1, 1): "done", (2, 0): "pending", (2, 1): "error", (3, 0): "running"}


def test_partition_overwrite_keeps_other_runs(spark, tmp_path):
    path = str(tmp_path / "acc")
    rows = lambda run, n: spark.range(n).withColumn("run_id", F.lit(run))
    sinks.write_by_run(rows(1, 5).union(rows(2, 6)), path)
    sinks.write_by_run(rows(2, 2), path)
    assert sinks.read_run(spark, path, 1).count() == 5 and sinks.read_run(spark, path, 2).count() == 2
    plan = sinks.read_run(spark, path, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_reading_a_run_lists_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "acc")
    for kind, runs in (("int", [1, 2, 3]), ("str", ["a", "b c", "d=e", "7", "x-1"])):
        rows = spark.createDataFrame([(run, k) for run in runs for k in range(len(str(run)) + 1)], "run_id %s, k int" % kind.replace("str", "string"))
        sinks.write_by_run(rows, f"{path}/{kind}")
        for run in runs:
            assert sorted(r["k"] for r in sinks.read_run(spark, f"{path}/{kind}", run).collect()) == list(range(len(str(run)) + 1))
        assert sinks.read_run(spark, f"{path}/{kind}", 99 if kind == "int" else "none").count() == 0
    assert all("/run_id=2/" in f for f in sinks.read_run(spark, f"{path}/int", 2).inputFiles())
    assert all("/run_id=x-1/" in f for f in sinks.read_run(spark, f"{path}/str", "x-1").inputFiles())


def test_runs_of_a_shared_store_share_files(spark, tmp_path):
    path, runs = str(tmp_path / "acc"), 3 * sinks.FOLDERS
    rows = spark.range(4 * runs).select((F.col("id") % runs).alias("run_id"), F.col("id").alias("k"))
    sinks.write_by_run(rows.union(spark.sql("SELECT CAST(NULL AS BIGINT), 9L")), path, shared=True)
    files = [f for f in os.listdir(path) if "=" in f for f in os.listdir(f"{path}/{f}") if f.endswith(".parquet")]
    assert len(files) <= sinks.FOLDERS
    found = sinks.read_run(spark, path, 7)
    assert found.columns == ["run_id", "k"] and sorted(map(tuple, found.collect())) == [(7, 7 + i * runs) for i in range(4)]
    assert len({os.path.dirname(f) for f in found.inputFiles()}) == 1
    assert sinks.read_run(spark, path, runs).count() == 0 and spark.read.parquet(path).filter("run_id IS NULL").count() == 1
    assert spark.read.parquet(path).count() == 4 * runs + 1
    placed = spark.read.parquet(path).groupBy("run_id").agg(F.count_distinct("run_folder").alias("n"))
    assert placed.filter("n > 1").count() == 0


def test_files_of_cleaned_runs_do_not_grow_with_the_runs(spark, tmp_path):
    spark.range(1200).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id % 600 AS l_suppkey", "id % 50 + 1D AS l_quantity", "id % 11 / 100D AS l_discount",
        "substr('ANR', cast(id % 3 + 1 AS int), 1) AS l_returnflag", "if(id % 2 = 0, 'O', 'F') AS l_linestatus",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    path = storage_plans._write_cleaned(spark, str(tmp_path))
    assert len(spark.read.parquet(path).inputFiles()) <= 200  # 600 runs
    kept = storage_plans.flagged(spark, str(tmp_path), ("l_orderkey", "l_suppkey")).filter("NOT is_quarantined")
    want = sorted(r["l_orderkey"] for r in kept.filter("l_suppkey = 7").collect())
    assert spark.read.parquet(path).count() == kept.count()
    assert sorted(r["l_orderkey"] for r in sinks.read_run(spark, path, 7).collect()) == want and len(want) > 0


def test_a_rerun_in_a_shared_store_keeps_the_runs_beside_it(spark, tmp_path):
    path, runs = str(tmp_path / "acc"), 3 * sinks.FOLDERS
    rows = spark.range(2 * runs).select((F.col("id") % runs).alias("run_id"), F.col("id").alias("k"))
    sinks.write_by_run(rows.union(rows.filter("k = 5")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 9L")), path, shared=True)
    sinks.write_by_run(spark.createDataFrame([(7, -1, "x"), (runs, -2, "y"), (None, -3, "z")], "run_id long, k long, note string"), path, shared=True)
    want = [(i, i + j * runs, None) for i in range(runs) if i != 7 for j in range(2)] + [(5, 5, None), (7, -1, "x"), (runs, -2, "y"), (None, -3, "z")]
    key = lambda r: tuple((v is None, v) for v in r)
    got = spark.read.option("mergeSchema", "true").parquet(path).select("run_id", "k", "note")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert [r["k"] for r in sinks.read_run(spark, path, 7).collect()] == [-1] and sinks.read_run(spark, path, 5).count() == 3


def test_runs_of_a_shared_store_may_be_any_text(spark, tmp_path):
    path, runs = str(tmp_path / "acc"), ["a", "b c", "d=e", "7", "x-1", "", "run_id=a"]
    sinks.write_by_run(spark.createDataFrame([(run, k) for run in runs for k in range(len(run) + 1)], "run_id string, k int"), path, shared=True)
    for run in runs:
        assert sorted(r["k"] for r in sinks.read_run(spark, path, run).collect()) == list(range(len(run) + 1))
    assert sinks.read_run(spark, path, "none").count() == 0


def test_arriving_rows_are_flagged_once(spark, tmp_path, monkeypatch):
    folder, kept = tmp_path / "in" / "a", []
    folder.mkdir(parents=True)
    (folder / "one.csv").write_text("k,qty\n1,5\n2,x\n")
    monkeypatch.setattr(ingest, "stored", lambda df, name: kept.append((name, df.count())) or stored(df, name))
    rules = [ColumnRule("qty", "float", "numeric", min=0.0, max=9.0)]
    ledger = ingest.ingest(ingest.incoming(spark, str(tmp_path / "in"), ["k", "qty"]), rules, str(tmp_path / "work"), ["k"])
    assert [tuple(r) for r in ledger.collect()] == [("a", 2, 1, 1, "processed")] and kept == [("flagged", 2)]

"""S1 over file splits; the gate in front of T3, T4 and T5."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracefold.operators.parse import read_log_lines
from tracefold.session import ensure_checkpoint_dir
from tracefold.streaming import gate as G
from tracefold.streaming import windows as SW

SCHEMA = "source_id string, entry_no long, ts timestamp, level string, message string"


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/test-{uuid.uuid4().hex[:12]}"


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_line_numbers_of_a_file_read_by_many_tasks(spark, tmp_path, ending):
    rng = random.Random(3)
    want = {}
    for name, n in (("a", 5000), ("b", 3), ("c", 1), ("empty", 0)):
        lines = [rng.choice(["", "  ", "x" * rng.randint(1, 90), "é" * 40, "tab\there"]) for _ in range(n)]
        (tmp_path / f"{name}.log").write_bytes(ending.join(lines).encode() + (b"\n" if name == "c" else b""))
        want |= {(name, i): x for i, x in enumerate(lines, 1) if x.strip()}
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = read_log_lines(spark, f"{tmp_path}/*.log", split_bytes=1000)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == usual
    got = {(r["source_id"].rsplit("/", 1)[1][:-4], r["line_no"]): r["line"] for r in df.collect()}
    assert got == want
    assert {k: v for k, v in got.items() if k[0] == "a"}.keys() == {
        (r["source_id"].rsplit("/", 1)[1][:-4], r["line_no"]) for r in read_log_lines(spark, f"{tmp_path}/a.log").collect()}


def shipments(spark, path, parts):
    for part in parts:
        rows = [(s, i, f"2024-01-01 {t}" if t else None, "ERROR" if i % 2 else "INFO", f"m{i % 3}") for s, i, t in part]
        (spark.createDataFrame(rows, "source_id string, entry_no long, ts string, level string, message string")
         .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{path}/in"))


PARTS = [[("a", 1, "10:00:00"), ("b", 2, "09:59:00")], [("a", 3, "10:05:00"), ("b", 4, "10:00:30")],
         [("a", 5, "10:06:00"), ("b", 6, "10:01:00"), ("b", 7, "10:04:30"), ("c", 8, None)],
         [("a", 9, "10:06:30"), ("b", 10, "10:02:00")], [("close", 0, "23:00:00")]]


def gated(spark, delay=120):
    path = folder(spark)
    shipments(spark, path, PARTS)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    G.start_gate(stream, f"{path}/gate", f"{path}/ckpt", delay).awaitTermination()
    return path


def test_gate_parts_late_rows_by_the_earlier_batches(spark):
    path = gated(spark)
    late = {r["entry_no"] for r in G.late_rows(spark, f"{path}/gate", SCHEMA).collect()}
    passed = {r["entry_no"] for r in spark.read.schema(SCHEMA).parquet(f"{path}/gate/passed/batch_id=*").collect()}
    # 2 minutes behind the newest time before: 10:00 for batch 1, 10:05 for 2, 10:06 for 3
    assert late == {6, 8, 10} and passed == {0, 1, 2, 3, 4, 5, 7, 9}


def test_a_replayed_batch_changes_nothing(spark):
    path = gated(spark)
    before = sorted(map(tuple, spark.read.parquet(f"{path}/gate/passed/batch_id=*").collect()), key=str)
    again = spark.read.schema(SCHEMA).parquet(f"{path}/in")
    for n in range(len(PARTS)):
        G.gate_batch(again, n, f"{path}/gate", 120)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/gate/passed/batch_id=*").collect()), key=str) == before


@pytest.mark.parametrize("aggregate", [
    lambda e: SW.windowed_patterns(e, "60 seconds", "30 seconds", watermark="120 seconds"),
    lambda e: SW.windowed_patterns(e, "60 seconds", watermark="120 seconds"),
    lambda e: SW.session_clusters(e, "90 seconds", watermark="120 seconds"),
    lambda e: SW.windowed_error_rate(e, "60 seconds", watermark="120 seconds")])
def test_stream_of_passed_rows_equals_the_batch_twin(spark, aggregate):
    path = gated(spark)
    (aggregate(G.passed_stream(spark, f"{path}/gate", SCHEMA)).writeStream.format("parquet").outputMode("append")
     .option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt2").trigger(availableNow=True)
     .start().awaitTermination())
    out = spark.read.parquet(f"{path}/out")
    twin = aggregate(spark.read.schema(SCHEMA).parquet(f"{path}/gate/passed/batch_id=*").where("source_id <> 'close'"))
    assert sorted(map(str, out.select(twin.columns).collect())) == sorted(map(str, twin.collect())) and out.count() > 3

"""Stream = batch: T1 against W1, T3/T5 against their batch twins, T6 idempotence."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracefold.operators import correlate as C
from tracefold.operators import parse as P
from tracefold.plans.fixture import log_lines
from tracefold.session import ensure_checkpoint_dir
from tracefold.streaming import flush as SF
from tracefold.streaming import sources as SS
from tracefold.streaming import windows as SW


def land_in_chunks(spark, n_chunks):
    """Fixture lines as time-ordered files: whole events per chunk, one file each,
    written in order (the order a log agent would ship them)."""
    base = f"{ensure_checkpoint_dir(spark)}/test-stream-{uuid.uuid4().hex[:8]}"
    lines = log_lines(spark, SF_SMALL)
    top = lines.agg(F.max("line_no")).first()[0]
    step = ((top // n_chunks) // 4 + 1) * 4
    for c in range(n_chunks):
        part = lines.where((F.col("line_no") >= c * step) & (F.col("line_no") < (c + 1) * step))
        (part.select("source_id", F.concat("source_id", F.lit(f"/{c}")).alias("file"), "line_no", "line")
         .coalesce(1).write.mode("append").parquet(f"{base}/in"))
    return base, lines


def run_flush(spark, base, files_per_trigger):
    flushed = SF.stream_flush(SS.stream_log_lines(spark, f"{base}/in", max_files_per_trigger=files_per_trigger))
    q = (flushed.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_flush_stream_equals_batch_segments(spark):
    for n_chunks, per_trigger in ((3, 1), (4, 2)):
        base, lines = land_in_chunks(spark, n_chunks)
        out = run_flush(spark, base, per_trigger)
        assert out.where(F.col("reason") == "late").count() == 0
        got = sorted((r.source_id, r.flush_no, r.entry_no) for r in out.where("flush_no >= 0").collect())
        segs = C.flush_segments(P.fold_entries(lines), lookback_seconds=60)
        want = sorted((r.source_id, r.segment, r.entry_no) for r in segs.collect())
        assert got == want and len(got) > 0


def test_lagging_source_and_late_heads_lose_nothing(spark):
    base = f"{ensure_checkpoint_dir(spark)}/test-lag-{uuid.uuid4().hex[:8]}"
    batches = [
        [("b", 1, "2024-01-01T10:10:00Z INFO up"), ("b", 2, "2024-01-01T10:10:01Z ERROR b-boom"), ("b", 3, "  at b.frame")],
        [("a", 1, "2024-01-01T10:00:30Z ERROR a-boom"), ("a", 2, "  at a.frame"), ("b", 4, "2024-01-01T10:10:06Z WARN head"),
         ("b", 5, "2024-01-01T10:01:00Z ERROR late-in-file"), ("b", 6, "  at late.frame")],
        [("b", 7, "  at orphan"), ("a", 3, "SHUTDOWN"), ("b", 8, "SHUTDOWN")],
    ]
    for n, rows in enumerate(batches):
        (spark.createDataFrame(rows, "source_id string, line_no long, line string")
         .select("source_id", F.concat("source_id", F.lit(f"/{n}")).alias("file"), "line_no", "line")
         .coalesce(1).write.mode("append").parquet(f"{base}/in"))
    out = run_flush(spark, base, 1)
    got = sorted((r.source_id, r.entry_no, r.reason, r.message.count("\n")) for r in out.collect())
    assert got == [("a", 1, "error_detected", 1), ("b", 1, "error_detected", 0), ("b", 2, "error_detected", 1),
                   ("b", 4, "shutdown", 0), ("b", 5, "late", 1), ("b", 7, "orphan", 0)]


def test_windowed_stream_subset_of_batch(spark):
    base, lines = land_in_chunks(spark, 3)
    entries_stream = SS.stream_log_lines(spark, f"{base}/in", max_files_per_trigger=1)
    # entries in a stream: head lines only carry ts/level (continuations are folded in T1)
    heads = SF.prepare_lines(entries_stream).where(F.col("ts").isNotNull()).select(
        "source_id", F.col("line_no").alias("entry_no"), "ts", "level", F.col("line").alias("message"))
    q = (SW.windowed_error_rate(heads, window="1 hour", watermark="1 hour").writeStream.format("parquet")
         .option("path", f"{base}/t5").option("checkpointLocation", f"{base}/t5ck").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = {tuple(r) for r in spark.read.parquet(f"{base}/t5").collect()}
    batch_heads = SF.prepare_lines(lines).where(F.col("ts").isNotNull()).select(
        "source_id", F.col("line_no").alias("entry_no"), "ts", "level", F.col("line").alias("message"))
    batch = {tuple(r) for r in SW.windowed_error_rate(batch_heads, window="1 hour").collect()}
    assert streamed and streamed <= batch
    assert len(streamed) >= 0.9 * len(batch)


def test_upsert_batches_idempotent(spark):
    base = f"{ensure_checkpoint_dir(spark)}/test-upsert-{uuid.uuid4().hex[:8]}"
    b0 = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n long")
    b1 = spark.createDataFrame([("a", 5)], "id string, n long")
    SS.upsert_batch(b0, 0, base)
    SS.upsert_batch(b1, 1, base)
    SS.upsert_batch(b1, 1, base)                      # replayed batch rewrites its own folder
    got = sorted((r.id, r.n, r.version) for r in SS.read_upserted(spark, base).collect())
    assert got == [("a", 5, 1), ("b", 1, 0)]


def test_flush_takes_bounded_shipments(spark, monkeypatch):
    """T1's queries: a micro-batch holds a bounded part of the lines, not a whole source;
    entries out of line order, heads without a time and lines before a head included."""
    from tracefold.plans import q_stream as QS
    rows = []
    for i in range(300):
        sec = (i * 7) % 300                                    # times are not in line order
        for source in ("a", "b"):
            rows += [(source, 10 * i + 4, f"2024-01-01 10:{sec // 60:02d}:{sec % 60:02d} {'ERROR' if sec % 11 == 0 else 'INFO'} m{i}"),
                     (source, 10 * i + 5, f"  at frame {i}")]
            if i % 50 == 3:
                rows.append((source, 10 * i + 6, f"2024-13-41 99:99:99 INFO no time {i}"))
    rows += [("a", 1, "  before any head")]
    lines = spark.createDataFrame(rows, "source_id string, line_no long, line string").withColumn("container", F.lit("c"))
    monkeypatch.setattr(QS, "log_lines", lambda *_: lines)

    def flushed(ship_bytes):
        monkeypatch.setattr(QS, "SHIP_BYTES", ship_bytes)
        base, _ = QS._run_flush(spark, SF_SMALL, shutdown=True)
        files = spark.read.parquet(f"{base}/in").groupBy(F.col("_metadata.file_path")).count().collect()
        out = spark.read.schema(SF.OUTPUT_SCHEMA).parquet(f"{base}/out")
        return max(r["count"] for r in files), sorted(map(str, out.collect()))

    small, got = flushed(10_000)
    whole, want = flushed(1 << 30)
    assert got == want and len(got) == 609                   # four entries follow the SHUTDOWN in time
    assert small < 150 and whole == len(rows) + 2             # 10 000 bytes, and a second's lines more

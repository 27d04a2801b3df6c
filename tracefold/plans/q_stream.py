"""Registered queries: streaming operators.

All of them run Structured Streaming queries (``availableNow``) over files in a
scratch folder under the session's checkpoint directory, writing to sinks that
are read back.  T1/S2/T6 read the fixture lines; T3/T4/T5 read entries that arrive
in shipments, one file each, in which two sources lag behind the others: a gate
query parts the late entries, a windowed query with a watermark aggregates the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions import time as TM
from tracefold.functions.time import iso_seconds
from tracefold.operators.parse import DEFAULT_LINE_BUCKET
from tracefold.operators.scan import carry_forward_max, numeric_bucket, running_sum
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.fixture import log_lines
from tracefold.plans.registry import register
from tracefold.session import delete_on_exit, ensure_checkpoint_dir
from tracefold.streaming import flush as SF
from tracefold.streaming import sources as SS
from tracefold.streaming import windows as SW

GAP = FL.FIXTURE_GAP_SECONDS


def _scratch(spark) -> str:
    return delete_on_exit(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tracefold-stream-{uuid.uuid4().hex[:12]}")


def _agent_lines(spark, sf_dir, shutdown: bool = False) -> DataFrame:
    """The fixture lines as a log agent would ship them (one logical file per
    source), each file with a SHUTDOWN line at its end on request."""
    lines = log_lines(spark, sf_dir).select("source_id", F.col("source_id").alias("file"), "line_no", "line")
    if shutdown:
        lines = lines.unionByName(lines.groupBy("source_id", "file").agg(
            (F.max("line_no") + 1).alias("line_no"), F.lit(SF.SHUTDOWN).alias("line")))
    return lines


def _land_lines(spark, sf_dir, base: str) -> str:
    """Write the fixture lines, a source's lines in one file."""
    path = f"{base}/in"
    _agent_lines(spark, sf_dir).repartition("source_id").sortWithinPartitions("line_no").write.parquet(path)
    return path


#: bytes of a shipment's lines, LINE_BYTES for each line's other columns included
SHIP_BYTES = 128 << 20
LINE_BYTES = 100


def _land_in_order(rows: DataFrame, base: str) -> str:
    """Write a file for each value of ``ship``, one after another: the file source
    takes files in the order of their times.  The rows are dealt by ``ship`` once,
    so that each file's job reads its own rows only."""
    staged, path = f"{base}/staged", f"{base}/in"
    rows.where("ship IS NOT NULL").repartition("ship").write.partitionBy("ship").parquet(staged)
    dealt = rows.sparkSession.read.schema(rows.schema).parquet(staged)
    for (n,) in dealt.select("ship").distinct().orderBy("ship").collect():
        dealt.where(F.col("ship") == n).drop("ship").coalesce(1).write.mode("append").parquet(path)
    return path


def _time_ordered(lines: DataFrame, ship_bytes: int) -> DataFrame:
    """``lines`` with the number of their ``ship``: whole entries in the order of
    their times, ``ship_bytes`` a shipment and at most one second's lines more.  A
    line goes with the last head before it, a head without a time too; lines before
    every head go first."""
    from tracefold.plans.materialize import materialize
    head_ts = F.when(TM.is_head_b(F.col("line")), TM.ts_b(F.col("line")))
    d = lines.withColumn("__t", head_ts)
    d = carry_forward_max(d, ["source_id", "file"], ["line_no"], F.when(F.col("__t").isNotNull(), F.struct("line_no", "__t")),
                          "__last", numeric_bucket("line_no", DEFAULT_LINE_BUCKET))
    sec = F.coalesce(F.unix_seconds(F.coalesce("__t", "__last.__t").cast("timestamp")), F.lit(-(1 << 60)))
    d = materialize(d.select(*lines.columns, sec.alias("sec")), "timed_lines")
    size = d.groupBy("sec").agg(F.sum(F.coalesce(F.octet_length("line"), F.lit(0)) + LINE_BYTES).alias("n"))
    upto = running_sum(size, [], ["sec"], F.col("n"), "upto", numeric_bucket("sec", 3600))
    ships = upto.select("sec", F.floor((F.col("upto") - F.col("n")) / ship_bytes).cast("long").alias("ship"))
    return d.join(ships, "sec").drop("sec")


def _run_flush(spark, sf_dir, window_seconds=60, foreach=None, shutdown=False) -> tuple[str, DataFrame | None]:
    base = _scratch(spark)
    src = _land_in_order(_time_ordered(_agent_lines(spark, sf_dir, shutdown), SHIP_BYTES), base)
    # a shipment is one file that one or two tasks read: its lines are dealt out before they are parsed
    stream = SS.stream_log_lines(spark, src, max_files_per_trigger=1).repartition("source_id", "line_no")
    flushed = SF.stream_flush(stream, window_seconds=window_seconds)
    w = flushed.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
    if foreach is None:
        q = w.format("parquet").option("path", f"{base}/out").outputMode("append").start()
    else:
        q = w.foreachBatch(lambda b, i: foreach(b, i, f"{base}/upsert")).start()
    q.awaitTermination()
    return base, None


@register("S2_stream_log_lines", "WITH " + O.log_lines_cte().replace("\n", "\n", 1) + """
SELECT source_id, line_no, line FROM log_lines""")
def q_stream_log_lines(spark, sf_dir):
    base = _scratch(spark)
    src = _land_lines(spark, sf_dir, base)
    q = (SS.stream_log_lines(spark, src, max_files_per_trigger=2).writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("source_id", "line_no", "line")


_W1_60 = "WITH " + O.entries_ctes() + f""",
w1a AS (SELECT *, CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY entry_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END
    AS segment FROM entries),
w1e AS (SELECT source_id, segment, ts AS error_ts, entry_no AS err_no FROM w1a WHERE level = 'ERROR'),
seg AS (SELECT w1a.*, error_ts FROM w1a JOIN w1e USING (source_id, segment)
  WHERE entry_no = err_no OR ts >= error_ts - INTERVAL 60 SECOND)"""


@register("T1_stream_flush", _W1_60 + f"""
SELECT source_id, segment AS flush_no, 'error_detected' AS reason, entry_no, level, {O.iso_s('ts')} AS ts,
  {O.iso_s('error_ts')} AS flushed_at FROM seg""")
def q_stream_flush(spark, sf_dir):
    base, _ = _run_flush(spark, sf_dir)
    out = spark.read.parquet(f"{base}/out").where("flush_no >= 0")
    return out.select("source_id", "flush_no", "reason", "entry_no", "level", iso_seconds(F.col("ts")).alias("ts"),
                      iso_seconds(F.col("flushed_at")).alias("flushed_at"))


@register("T1_stream_reasons", _W1_60 + """,
every AS (SELECT w1a.*, w1e.error_ts, coalesce(w1e.error_ts, max(ts) OVER (PARTITION BY w1a.source_id)) AS end_ts
  FROM w1a LEFT JOIN w1e USING (source_id, segment)),
judged AS (SELECT *, ts >= end_ts - INTERVAL 60 SECOND AS kept FROM every)
SELECT source_id, entry_no, level, CASE WHEN kept THEN segment ELSE -1 END AS flush_no,
  CASE WHEN NOT kept THEN 'pruned' WHEN error_ts IS NULL THEN 'shutdown' ELSE 'error_detected' END AS reason,
  length(message) AS n_chars FROM judged""")
def q_stream_reasons(spark, sf_dir):
    """T1 with T2: every entry once, with the reason for which it left the buffer;
    a SHUTDOWN line ends each source."""
    base, _ = _run_flush(spark, sf_dir, shutdown=True)
    return spark.read.parquet(f"{base}/out").select("source_id", "entry_no", "level", "flush_no", "reason",
                                                    F.length("message").cast("long").alias("n_chars"))


def _upsert_flushes(batch: DataFrame, batch_id: int, path: str) -> None:
    inc = (batch.where("flush_no >= 0")
           .groupBy("source_id", "flush_no").agg(F.count(F.lit(1)).alias("n_entries"),
                                                 F.max("ts").alias("last_ts"))
           .select(F.concat(F.col("source_id"), F.lit("#"), F.col("flush_no").cast("string")).alias("id"),
                   "n_entries", "last_ts"))
    SS.upsert_batch(inc, batch_id, path)


@register("T6_stream_upsert", _W1_60 + f"""
SELECT source_id || '#' || CAST(segment AS VARCHAR) AS id, count(*) AS n_entries, {O.iso_s('max(ts)')} AS last_ts
FROM seg GROUP BY source_id, segment""")
def q_stream_upsert(spark, sf_dir):
    base, _ = _run_flush(spark, sf_dir, foreach=_upsert_flushes)
    u = SS.read_upserted(spark, f"{base}/upsert")
    return u.select("id", "n_entries", iso_seconds(F.col("last_ts")).alias("last_ts"))


# --- T3, T4, T5: shipments of entries, a gate, windowed state ----------------

SHIP_DAYS = 4
DELAY_DAYS = 6
#: shipments by which a source lags: one is within the delay, two are not always
LAGS = {"payment-service": 1, "frontend-web": 2}
CLOSE = "__close__"

_GATE = "WITH " + O.entries_ctes() + f""",
shipped AS (SELECT *, CAST(floor(epoch(ts) / {SHIP_DAYS * 86400}) AS BIGINT)
  + CASE source_id {" ".join(f"WHEN '{s}' THEN {n}" for s, n in LAGS.items())} ELSE 0 END AS ship FROM entries),
marks AS (SELECT ship, max(max(ts)) OVER (ORDER BY ship ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM shipped GROUP BY ship),
judged AS (SELECT shipped.*, CASE WHEN ts < newest - INTERVAL {DELAY_DAYS} DAY THEN 'late' ELSE 'window' END AS kind
  FROM shipped JOIN marks USING (ship))"""


#: shipments that a run of the windowed query takes at once: always whole ones, as its
#: watermark moves between its batches and would drop the rest of one that was cut
WINDOW_SHIPMENTS = 6


def _shipments(spark, sf_dir, base: str) -> tuple[list[DataFrame], object]:
    """Entries as agents would ship them, a frame per shipment in order, then a control
    row whose time closes every window; and their schema.  The rows are written by
    shipment once, by all tasks."""
    e = FL.entries_b(spark, sf_dir).select("source_id", "entry_no", "ts", "level", "message")
    lag = F.lit(0)
    for source, n in LAGS.items():
        lag = F.when(F.col("source_id") == source, n).otherwise(lag)
    e = e.withColumn("ship", F.floor(F.unix_timestamp("ts") / (SHIP_DAYS * 86400)).cast("long") + lag)
    e.write.partitionBy("ship").parquet(f"{base}/staged")   # no filter here: it would take every time from its text again
    dealt = spark.read.schema(e.schema).parquet(f"{base}/staged").where("ship IS NOT NULL")
    numbers = [n for (n,) in dealt.select("ship").distinct().orderBy("ship").collect()]
    close = spark.range(1).select(F.lit(CLOSE).alias("source_id"), F.lit(0).cast("long").alias("entry_no"),
                                  F.lit("2100-01-01 00:00:00").cast(e.schema["ts"].dataType).alias("ts"),
                                  F.lit("INFO").alias("level"), F.lit("").alias("message")).coalesce(1)
    return [*(dealt.where(F.col("ship") == n).drop("ship") for n in numbers), close], e.drop("ship").schema


def _run_windows(spark, sf_dir, aggregate) -> DataFrame:
    """``aggregate`` over the stream of passed entries (kind ``window``) and over the late ones (kind ``late``).
    A shipment lands in as many files as its tasks write, and the gate runs when it has
    landed, so that its files are one micro-batch whatever their number."""
    from tracefold.streaming import gate as G
    base = _scratch(spark)
    ships, schema = _shipments(spark, sf_dir, base)
    for i, rows in enumerate(ships, start=1):
        rows.write.mode("append").parquet(f"{base}/in")
        G.start_gate(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/gate", f"{base}/gate-ckpt",
                     DELAY_DAYS * 86400).awaitTermination()
        if i % WINDOW_SHIPMENTS == 0 or i == len(ships):
            (aggregate(G.passed_stream(spark, f"{base}/gate", schema)).writeStream.format("parquet").outputMode("append")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
             .start().awaitTermination())
    late = aggregate(G.late_rows(spark, f"{base}/gate", schema))
    return (spark.read.schema(late.schema).parquet(f"{base}/out").withColumn("kind", F.lit("window"))
            .unionByName(late.withColumn("kind", F.lit("late"))))


@register("T3_stream_patterns", _GATE + f""",
k AS (SELECT *, md5({O.norm_b_sql('message')}) AS pattern_key, make_timestamp(CAST((floor(epoch(ts) / 1800) * 1800 - s)
  * 1000000 AS BIGINT)) AS window_start FROM judged, (SELECT unnest([0, 1800]) AS s))
SELECT kind, {O.iso_s('window_start')} AS window_start, {O.iso_s('window_start + INTERVAL 1 HOUR')} AS window_end, source_id,
  pattern_key, count(*) AS count, {O.iso_s('min(ts)')} AS first_ts, {O.iso_s('max(ts)')} AS last_ts,
  min(entry_no) AS first_entry_no
FROM k GROUP BY kind, window_start, source_id, pattern_key""")
def q_stream_patterns(spark, sf_dir):
    """Sliding windows of an hour, each half hour."""
    p = _run_windows(spark, sf_dir, lambda e: SW.windowed_patterns(
        e, window="1 hour", slide="30 minutes", watermark=f"{DELAY_DAYS} days"))
    return p.select("kind", iso_seconds(F.col("window_start")).alias("window_start"),
                    iso_seconds(F.col("window_end")).alias("window_end"), "source_id", "pattern_key", "count",
                    iso_seconds(F.col("first_ts")).alias("first_ts"), iso_seconds(F.col("last_ts")).alias("last_ts"),
                    "first_entry_no")


@register("T4_stream_clusters", _GATE + f""",
g0 AS (SELECT *, lag(ts) OVER (PARTITION BY kind, source_id ORDER BY ts, entry_no) AS prev FROM judged),
g1 AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {GAP * 1_000_000} THEN 1 ELSE 0 END)
  OVER (PARTITION BY kind, source_id ORDER BY ts, entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sess FROM g0)
SELECT kind, source_id, {O.iso_s('min(ts)')} AS first_ts, {O.iso_s('max(ts)')} AS last_ts, count(*) AS n_entries,
  count_if(level = 'ERROR') AS n_errors FROM g1 GROUP BY kind, source_id, sess""")
def q_stream_clusters(spark, sf_dir):
    c = _run_windows(spark, sf_dir, lambda e: SW.session_clusters(e, gap=f"{GAP} seconds", watermark=f"{DELAY_DAYS} days"))
    return c.select("kind", "source_id", iso_seconds(F.col("first_ts")).alias("first_ts"),
                    iso_seconds(F.col("last_ts")).alias("last_ts"), "n_entries", "n_errors")


@register("T5_stream_error_rate", _GATE + f""",
k AS (SELECT *, make_timestamp(CAST(floor(epoch(ts) / 3600) * 3600 * 1000000 AS BIGINT)) AS window_start FROM judged)
SELECT kind, {O.iso_s('window_start')} AS window_start, source_id, count_if(level = 'ERROR') AS error_count,
  count(*) AS entry_count, count_if(level = 'ERROR') / count(*) * 10.0 AS error_rate_z
FROM k GROUP BY kind, window_start, source_id""")
def q_stream_error_rate(spark, sf_dir):
    r = _run_windows(spark, sf_dir, lambda e: SW.windowed_error_rate(e, window="1 hour", watermark=f"{DELAY_DAYS} days"))
    return r.select("kind", iso_seconds(F.col("window_start")).alias("window_start"), "source_id", "error_count",
                    "entry_count", "error_rate_z")


@register("S1_read_log_lines", "WITH " + O.log_lines_cte() + """
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY line_no) AS BIGINT) AS line_no, line
FROM log_lines""")
def q_read_log_lines(spark, sf_dir):
    """The fixture lines written as one text file per source (as a log agent
    would leave them), read back in splits of 64 KiB with line numbers."""
    from tracefold.operators.parse import read_log_lines
    base = _scratch(spark)
    # sorted by (source, line) so the partitioned writer keeps the line order
    (log_lines(spark, sf_dir).repartition("source_id").sortWithinPartitions("source_id", "line_no")
     .select("source_id", "line").write.partitionBy("source_id").text(f"{base}/text"))
    r = read_log_lines(spark, f"{base}/text/*/*.txt", split_bytes=1 << 16)
    src = F.regexp_extract("source_id", r"source_id=([^/]+)/", 1)
    return r.select(src.alias("source_id"), "line_no", "line")

"""Documents, lines and patterns are worked out once; shipments land and are read by many tasks."""

import datetime as dt

from pyspark.sql import functions as F

from tracefold.operators import parse as P
from tracefold.operators import patterns as A
from tracefold.plans import flows as FL
from tracefold.plans import q_stream as QS
from tracefold.sources import bundles as SB
from tracefold.streaming import gate as G
from tracefold.streaming import windows as SW

LINES = [(s, 10 * i + j, f"2024-01-01 10:{i:02d}:00 {'ERROR' if i % 7 == 0 else 'INFO'} step {i % 3}" if j == 0 else f"  at f{j}", "c")
         for s in ("a", "b") for i in range(30) for j in range(3)]


def counted(spark):
    """A column function that passes its value on, and the number of its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, "string").asNondeterministic(), calls


def lines(spark):
    return spark.createDataFrame(LINES, "source_id string, line_no long, line string, container string")


def test_a_document_is_parsed_once(spark, tmp_path):
    rows = [("a", '{"id": "x"}'), ("b", '{"bundle": {"id": "y", "logPatterns": [{"pattern": "p"}]}}'), ("c", "no")]
    spark.createDataFrame(rows, "k string, json string").write.parquet(f"{tmp_path}/docs")
    bundles, corrupt = SB.read_bundles(spark.read.parquet(f"{tmp_path}/docs"), keep=("k",))
    for df in (bundles, corrupt, SB.explode_bundles(bundles)["patterns"]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(StructField(id") == 1
    assert sorted(r.id for r in bundles.collect()) == ["x", "y"] and [r.k for r in corrupt.collect()] == ["c"]


def test_a_document_too_large_for_a_variant_is_no_corrupt_one(spark, tmp_path):
    names = F.repeat(F.concat(F.repeat(F.lit("x"), F.lit(1000)), F.lit('","')), F.lit(140_000))
    docs = spark.range(2).select(F.col("id").alias("k"), F.concat(
        F.lit('{"id":"x","dependencyGraph":["'), names, F.lit('"'), F.when(F.col("id") == 0, "]}").otherwise("")).alias("json"))
    docs.write.parquet(f"{tmp_path}/docs")
    bundles, corrupt = SB.read_bundles(spark.read.parquet(f"{tmp_path}/docs"), keep=("k",))
    assert bundles.select("k", "id", F.size("dependencyGraph")).collect() == [(0, "x", 140_001)]
    assert corrupt.select("k", "reason").collect() == [(1, "malformed")]


def test_lines_are_worked_out_once(spark):
    same, calls = counted(spark)
    entries = P.fold_entries(lines(spark).withColumn("line", same("line")))
    got = sorted((r.source_id, r.entry_no, r.message.count("\n")) for r in entries.collect())
    assert got == [(s, 10 * i, 2) for s in ("a", "b") for i in range(30)]
    assert calls.value == len(LINES)


def test_patterns_are_worked_out_once(spark, monkeypatch):
    same, calls = counted(spark)
    dedup = A.dedup_patterns_b
    monkeypatch.setattr(FL, "log_lines", lambda *_: lines(spark))
    monkeypatch.setattr(A, "dedup_patterns_b", lambda *a, **k: dedup(*a, **k).withColumn(
        "sev_rank", same(F.col("sev_rank").cast("string")).cast("int")))
    FL.reset_memo()
    try:
        rows = FL.patterns_b(spark, "none").orderBy("bundle_id", "pattern_ord").collect()
    finally:
        FL.reset_memo()
    assert [(r.bundle_id[0], r.pattern_ord, r["count"], r.error_class) for r in rows[:6]] == [
        ("a", i, n, c) for i, (n, c) in enumerate([(2, "ERROR"), (2, "ERROR"), (1, "ERROR"), (9, "INFO"), (8, "INFO"), (8, "INFO")])]
    assert calls.value == len(rows) == 12


def test_shipments_of_many_files_lose_no_entry(spark, monkeypatch):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, i, t0 + dt.timedelta(hours=i), "INFO", f"m{i % 5}") for s in ("a", "payment-service", "frontend-web") for i in range(600)]
    rows += [("a", 600, None, "INFO", "no time")]
    entries = spark.createDataFrame(rows, "source_id string, entry_no long, ts timestamp, level string, message string").repartition(6)
    bases = []
    scratch = QS._scratch
    monkeypatch.setattr(QS, "_scratch", lambda s: bases.append(scratch(s)) or bases[-1])
    monkeypatch.setattr(FL, "entries_b", lambda *_: entries)
    monkeypatch.setattr(QS, "WINDOW_SHIPMENTS", 2)
    out = QS._run_windows(spark, "none", lambda e: SW.windowed_error_rate(e, "1 hour", watermark=f"{QS.DELAY_DAYS} days"))
    got = {r.kind: r.n for r in out.where("source_id <> '__close__'").groupBy("kind").agg(F.sum("entry_count").alias("n")).collect()}
    first = (t0 - dt.datetime(1970, 1, 1)).days
    ship = {(s, i): (first + i // 24) // QS.SHIP_DAYS + QS.LAGS.get(s, 0) for s, i, t, *_ in rows if t}
    late = sum(1 for (s, i), n in ship.items() if any(m < n for m in ship.values())
               and i < max(j for (_, j), m in ship.items() if m < n) - 24 * QS.DELAY_DAYS)
    assert got == {"late": late, "window": len(ship) - late} and late
    files = spark.read.schema("entry_no long").parquet(f"{bases[0]}/in").select("_metadata.file_path").distinct().count()
    batches = spark.read.parquet(f"{bases[0]}/gate/newest").select("batch_id").distinct().count()
    assert batches == len(set(ship.values())) + 1 < files       # a batch for each shipment and the control row
    assert G.late_rows(spark, f"{bases[0]}/gate", entries.schema).count() == late

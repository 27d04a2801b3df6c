"""Bundle documents (S3, S4, P17), scans of W1 and J1 on awkward data, the prompt payload."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from tracefold.operators import correlate as C
from tracefold.operators import payload as P
from tracefold.sources import bundles as SB
from tracefold.streaming import flush as SF
from tracefold.streaming import sources as SS
from tracefold.streaming.bundle_sink import bundle_sink, read_sink


def test_documents_without_a_bundle_go_to_the_side_table(spark):
    docs = [("cut", '{"id": "x", "logPat'), ("null", None), ("array", '[{"id": "x"}]'), ("number", "5"), ("empty", "{}"),
            ("envelope", '{"use_rag": true}'), ("other", '{"foo": 1}'), ("good", ' {"bundle": {"id": "y", "metrics": null}}'),
            ("bare", '{"id": "z", "events": null, "metrics": {"cpuZ": 2.5}}')]
    bundles, corrupt = SB.read_bundles(spark.createDataFrame(docs, "k string, json string"), keep=("k",))
    why = {r.k: (r._corrupt_record, r.reason) for r in corrupt.collect()}
    assert {k: v[1] for k, v in why.items()} == {
        "cut": "malformed", "null": "malformed", "array": "not an object", "number": "not an object",
        "empty": "no bundle", "envelope": "no bundle", "other": "no bundle"}
    assert why["cut"][0] == docs[0][1]
    rows = {r.k: r for r in bundles.collect()}
    assert set(rows) == {"good", "bare"}
    assert rows["good"].metrics is not None and rows["good"].metrics.cpuZ is None and rows["good"].windowStart is None
    assert rows["bare"].metrics.cpuZ == 2.5 and rows["bare"].events == []


def test_replayed_batch_leaves_the_same_documents(spark, tmp_path):
    head = "2024-01-01 10:00:0{} {} svc worked on item {}"
    for n in range(2):
        rows = [("s", f"f{n}", i, head.format(2 * i + n, "ERROR" if i == 2 else "INFO", i)) for i in range(4)]
        spark.createDataFrame(rows, SS.LINE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        lines = SS.stream_log_lines(spark, str(tmp_path / "in"), max_files_per_trigger=1)
        q = (SF.stream_flush(lines).writeStream.option("checkpointLocation", str(tmp_path / "ckpt"))
             .trigger(availableNow=True).foreachBatch(bundle_sink(str(tmp_path / "out"), "q")).start())
        q.awaitTermination()
        return sorted((r.batch_id, r.json) for r in read_sink(spark, str(tmp_path / "out"), "q").collect())

    first = run()
    assert len(first) == 2 and all(json.loads(d)["bundle"]["flush_metadata"]["reason"] == "error_detected" for _, d in first)
    commits = tmp_path / "ckpt" / "commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (commits / name).exists():
            (commits / name).unlink()
    assert run() == first


def test_flush_segments_over_many_buckets(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, i, t0 + dt.timedelta(seconds=10 * i), rng.choice(["INFO", "INFO", "INFO", "ERROR", None]))
            for s in ("a", "b") for i in range(60)] + [("c", i, t0, "INFO") for i in range(9)]
    df = spark.createDataFrame(rows, "source_id string, entry_no long, ts timestamp, level string")
    want = set()
    for s in "abc":
        mine = [r for r in rows if r[0] == s]
        for r in mine:
            nxt = next((e for e in mine if e[1] >= r[1] and e[3] == "ERROR"), None)
            if nxt and (nxt[1] == r[1] or (nxt[2] - r[2]).total_seconds() <= 40):
                want.add((s, r[1], sum(e[1] < r[1] and e[3] == "ERROR" for e in mine), nxt[2]))
    got = C.flush_segments(df, lookback_seconds=40, bucket_width=4)
    assert {(r.source_id, r.entry_no, r.segment, r.error_ts) for r in got.collect()} == want
    assert got.columns == [*df.columns, "segment", "error_ts"]


def test_error_lookback_with_a_line_dated_far_ahead(spark):
    rng = random.Random(4)
    rows = [("s", f"b{i // 5:02d}", i, 100 * i + rng.randint(-400, 400), rng.choice(["INFO", "INFO", "ERROR"])) for i in range(100)]
    rows[7] = ("s", "b01", 7, 4_070_908_800, "INFO")
    df = spark.createDataFrame(rows, "source_id string, batch_id string, entry_no long, sec long, level string").withColumn(
        "ts", F.timestamp_seconds("sec"))
    want = set()
    for b in {r[1] for r in rows}:
        errors = [r for r in rows if r[1] == b and r[4] == "ERROR"]
        if errors:
            last = max(r[2] for r in rows if r[1] == b)
            want |= {(b, r[2]) for r in rows if r[2] <= last and r[3] >= errors[0][3] - 300}
    got = [(r.batch_id, r.entry_no) for r in C.error_lookback(df, lookback_seconds=300).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_payload_lists_are_ranked_before_they_are_cut(spark):
    t0 = dt.datetime(2024, 1, 1)
    win = spark.createDataFrame([("b", t0, None)], "bundle_id string, window_start timestamp, window_end timestamp")
    none = {"correlated": "primaryCluster string, secondaryClusters array<string>", "metrics": "cpu_z double, mem_z double, "
            "latency_z double, error_rate_z double", "nodes": "position long, node string", "hint": "hint string",
            "root": "root_service string", "affected": "affected_services array<string>",
            "sequence": "sequence_index long, ts timestamp, type string, message string"}
    empty = {k: spark.createDataFrame([], f"bundle_id string, {v}") for k, v in none.items()}
    events = spark.createDataFrame([("b", t0 + dt.timedelta(seconds=i), f"e{i:02d}", "Normal", f"r{i}", None, "p")
                                    for i in random.Random(1).sample(range(30), 30)],
                                   "bundle_id string, ts timestamp, id string, type string, reason string, service string, pod string")
    commits = spark.createDataFrame([("b", t0 + dt.timedelta(days=i % 7), f"{i % 7}abcdefgh", f"m{i % 7}", f"u{i % 7}", "r", "main")
                                     for i in range(14)], "bundle_id string, commit_ts timestamp, commit_hash string, "
                                    "message string, author string, repo string, branch string")
    similar = spark.createDataFrame([("b", 2, "y", "s", None, 0.456), ("b", 1, "x", "s", "h", 0.9)],
                                    "bundle_id string, rank long, id string, summary string, root_cause string, similarity double")
    d = json.loads(P.prompt_payload(win, events=events, commits=commits, similar=similar, **empty).first().payload)
    assert [e["reason"] for e in d["events"]] == [f"r{i}" for i in range(10)] and "service" not in d["events"][0]
    assert d["gitContext"]["recentCommits"] == [f"{i}abcdefg m{i}" for i in (6, 5, 4, 3, 2)]
    assert d["gitContext"]["userConfig"] == {"name": "u6"}
    assert d["similarIncidents"] == [{"id": "x", "summary": "s", "rootCause": "h", "similarityScore": 0.9},
                                     {"id": "y", "summary": "s", "similarityScore": 0.46}]
    assert d["metrics"] == {} and d["sequence"] == [] and d["window"] == {"start": "2024-01-01T00:00:00Z"}
    assert "rootService" not in d


def test_sink_works_the_messages_out_once(spark, tmp_path, monkeypatch):
    """The parts of a bundle are made of the batch's written patterns: no part normalises the messages again."""
    from tracefold.streaming import bundle_sink as BS
    from tracefold.streaming.flush import OUTPUT_SCHEMA
    plans, write = [], BS.write_bundles_batch
    monkeypatch.setattr(BS, "write_bundles_batch", lambda b, *a: (
        plans.append(b._jdf.queryExecution().optimizedPlan().toString()), write(b, *a)))
    at = "timestamp'2024-01-01 00:00:0{}'"
    rows = spark.sql(" UNION ALL ".join(
        f"SELECT 's', 0L, 'error_detected', {at.format(9)}, 's', {n}L, {at.format(n)}, '{lvl}', '{msg}'"
        for n, lvl, msg in ((1, "INFO", "poll"), (2, "INFO", "poll"), (9, "ERROR", "down")))).toDF(
        *[f.split()[0] for f in OUTPUT_SCHEMA.split(", ")])
    for _ in range(2):      # a replayed batch leaves the same documents
        bundle_sink(str(tmp_path), "q")(rows, 0)
    (doc,) = read_sink(spark, str(tmp_path), "q").collect()
    assert [(p["pattern"], p["count"]) for p in json.loads(doc.json)["bundle"]["logPatterns"]] == [("down", 1), ("poll", 2)]
    assert len(plans) == 2 and "md5" not in plans[0]

"""Registered queries: bundle documents of several producers (S4), their child
tables (P17), and the documents that a stream writes (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.q_extra import _P10
from tracefold.plans.q_stream import _W1_60, _run_flush
from tracefold.plans.registry import register
from tracefold.sources import bundles as SB

_FORM_SQL = "CAST((strpos('0123456789abcdef', substr(md5(bundle_id), 1, 1)) - 1) % 8 AS INTEGER)"
_ID_SQL = "'incident_' || substr(sha256(bundle_id), 1, 16)"
#: CTEs of patterns, graph, events, metrics and the summary's parts, and the documents that hold a bundle
_GOOD = _P10.rpartition("\nSELECT w.bundle_id")[0] + f""",
good AS (SELECT bundle_id, {_ID_SQL} AS id, {_FORM_SQL} AS form FROM win WHERE {_FORM_SQL} NOT IN (2, 6, 7))"""


def bundle_documents(spark, sf_dir) -> DataFrame:
    """``(doc_key, json)``: every bundle as one of eight producers would write it: an
    envelope, a bare bundle, one cut short, one with ``errorClass``, one with null
    objects, one with lists and an empty ``gitConfig``, an empty envelope, an array."""
    b = FL.assembled_b(spark, sf_dir)

    def text(*without: str) -> Column:
        return F.to_json(F.struct(*[c for c in SB.BUNDLE.fieldNames() if c in b.columns and c not in without]))

    def envelope(bundle: Column) -> Column:
        return F.concat(F.lit('{"use_rag":true,"top_k":5,"bundle":'), bundle, F.lit("}"))

    bare = text()
    nulls = F.regexp_replace(text("metrics", "dependencyGraph"), r"^\{", '{"metrics":null,"dependencyGraph":null,')
    lists = F.regexp_replace(F.regexp_replace(bare, r"^\{", '{"gitConfig":{},'), r'"affectedService":("[^"]*")',
                             r'"affectedService":[$1]')
    forms = [envelope(bare), bare, F.substring(bare, F.lit(1), F.floor(F.length(bare) / 2).cast("int")),
             F.replace(bare, F.lit('"severity":'), F.lit('"errorClass":')), envelope(nulls), lists,
             F.lit('{"use_rag":true,"top_k":5}'), F.concat(F.lit("["), bare, F.lit("]"))]
    form = (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("bundle_id"), 1, 1)) - 1) % 8
    choice = F.when(form == 0, forms[0])
    for i, f in enumerate(forms[1:], start=1):
        choice = choice.when(form == i, f)
    return b.select(F.col("bundle_id").alias("doc_key"), choice.alias("json"))


def _read(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from tracefold.plans.materialize import materialize
    return SB.read_bundles(materialize(bundle_documents(spark, sf_dir), "documents"), keep=("doc_key",))


@register("S4_bundle_fields", _GOOD + f"""
SELECT g.bundle_id AS doc_key, g.id, {O.iso_s('w.window_start')} AS window_start, {O.iso_s('w.window_end')} AS window_end,
  root_service, array_to_string(coalesce(affected_services, []), ',') AS affected_services, hint,
  true AS has_metrics, false AS has_git_config,
  CASE WHEN form <> 4 THEN round(m.cpu_z, 6) END AS cpu_z, CASE WHEN form <> 4 THEN round(m.mem_z, 6) END AS mem_z,
  CASE WHEN form <> 4 THEN round(m.latency_z, 6) END AS latency_z,
  CASE WHEN form <> 4 THEN round(m.error_rate_z, 6) END AS error_rate_z,
  CASE WHEN form <> 4 THEN array_to_string(coalesce(chain, []), ',') ELSE '' END AS graph
FROM good g JOIN win w USING (bundle_id) LEFT JOIN root USING (bundle_id) LEFT JOIN aff USING (bundle_id)
  LEFT JOIN hint USING (bundle_id) LEFT JOIN chain USING (bundle_id) LEFT JOIN metrics m USING (bundle_id)""")
def q_bundle_fields(spark, sf_dir):
    """The typed fields of every document that holds a bundle."""
    b, _ = _read(spark, sf_dir)
    z = [F.round(f"metrics.{c}", 6).alias(n) for c, n in (("cpuZ", "cpu_z"), ("memZ", "mem_z"), ("latencyZ", "latency_z"),
                                                         ("errorRateZ", "error_rate_z"))]
    return b.select("doc_key", "id", F.col("windowStart").alias("window_start"), F.col("windowEnd").alias("window_end"),
                    F.col("rootService").alias("root_service"),
                    F.array_join("affectedServices", ",").alias("affected_services"),
                    F.col("derivedRootCauseHint").alias("hint"), F.col("metrics").isNotNull().alias("has_metrics"),
                    F.col("git_config").isNotNull().alias("has_git_config"), *z,
                    F.array_join("dependencyGraph", ",").alias("graph"))


@register("S4_corrupt_bundles", "WITH " + O.patterns_b_ctes() + f""",
d AS (SELECT DISTINCT bundle_id, {_FORM_SQL} AS form FROM patterns_b)
SELECT bundle_id AS doc_key, CASE form WHEN 2 THEN 'malformed' WHEN 6 THEN 'no bundle' ELSE 'not an object' END AS reason,
  CASE form WHEN 2 THEN '{{"id":' WHEN 6 THEN '{{"use_' ELSE '[{{"id"' END AS record_start
FROM d WHERE form IN (2, 6, 7)""")
def q_corrupt_bundles(spark, sf_dir):
    """The side table of documents without a bundle."""
    _, corrupt = _read(spark, sf_dir)
    return corrupt.select("doc_key", "reason", F.substring("_corrupt_record", 1, 6).alias("record_start"))


@register("P17_explode_patterns", _GOOD + f"""
SELECT id, CAST(pattern_ord AS BIGINT) AS ord, pattern, count, {O.iso_s('first_ts')} AS first_occurrence,
  {O.iso_s('last_ts')} AS last_occurrence, error_class AS severity, {O.clean_service_sql('container')} AS affected_service,
  CAST(1 AS BIGINT) AS n_affected FROM patterns_b JOIN good USING (bundle_id)""")
def q_explode_patterns(spark, sf_dir):
    p = SB.explode_bundles(_read(spark, sf_dir)[0])["patterns"]
    return p.select("id", "ord", "pattern", "count", F.col("firstOccurrence").alias("first_occurrence"),
                    F.col("lastOccurrence").alias("last_occurrence"), "severity",
                    F.array_join("affectedService", ",").alias("affected_service"),
                    F.size("affectedService").cast("long").alias("n_affected"))


@register("P17_explode_events", _GOOD + f"""
SELECT g.id, row_number() OVER (PARTITION BY g.bundle_id ORDER BY e.ts, e.id) - 1 AS ord, e.id AS event_id, e.type,
  e.reason, e.pod, e.service, {O.iso_s('e.ts')} AS ts FROM ev_b e JOIN good g ON e.bundle_id = g.bundle_id""")
def q_explode_events(spark, sf_dir):
    b, _ = _read(spark, sf_dir)
    e = SB.explode_bundles(b.withColumnRenamed("id", "bundle"), key="bundle")["events"]
    return e.select(F.col("bundle").alias("id"), "ord", F.col("id").alias("event_id"), "type", "reason", "pod", "service",
                    F.col("timestamp").alias("ts"))


@register("P17_explode_sequence", _GOOD + f""",
seq AS (SELECT bundle_id, first_ts AS ts, 'log' AS type, pattern_key AS item_id,
    '[' || {O.clean_service_sql('container')} || '] ' || pattern AS message FROM patterns_b
  UNION ALL SELECT bundle_id, ts, 'event', id, reason FROM ev_b),
sq AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ts ASC NULLS FIRST, type, item_id) - 1 AS n FROM seq)
SELECT id, n AS ord, {O.iso_s('ts')} AS ts, type, message, n AS sequence_index FROM sq JOIN good USING (bundle_id)""")
def q_explode_sequence(spark, sf_dir):
    s = SB.explode_bundles(_read(spark, sf_dir)[0])["sequence"]
    return s.select("id", "ord", F.col("timestamp").alias("ts"), "type", "message",
                    F.col("sequenceIndex").alias("sequence_index"))


@register("S3_stream_bundles", _W1_60 + f""",
fe AS (SELECT *, source_id || '#' || CAST(segment AS VARCHAR) AS bundle_id, md5({O.norm_b_sql('message')}) AS pattern_key,
  row_number() OVER (PARTITION BY source_id, segment ORDER BY ts ASC NULLS FIRST, entry_no) AS n FROM seg),
fp AS (SELECT bundle_id, source_id, pattern_key, arg_min(message, n) AS pattern, count(*) AS count,
  arg_min(ts, n) AS first_ts, arg_max(ts, n) AS last_ts, arg_min(level, n) AS severity, min(n) AS first_n
  FROM fe GROUP BY ALL),
fw AS (SELECT bundle_id, min(first_ts) AS window_start, max(last_ts) AS window_end,
  bool_or(severity IN ('ERROR', 'WARNING')) AS affects FROM fp GROUP BY bundle_id),
fm AS (SELECT bundle_id, count(*) AS log_count, max(error_ts) AS flushed_at FROM fe GROUP BY bundle_id)
SELECT {_ID_SQL} AS id, {O.iso_s('window_start')} AS window_start, {O.iso_s('window_end')} AS window_end,
  CASE WHEN affects THEN {O.clean_service_sql('source_id')} ELSE '' END AS affected_services,
  'error_detected' AS reason, log_count, {O.iso_s('flushed_at')} AS flushed_at,
  row_number() OVER (PARTITION BY bundle_id ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1
    WHEN 'INFO' THEN 2 ELSE 3 END, count DESC, first_n) - 1 AS ord, pattern, count, severity
FROM fp JOIN fw USING (bundle_id) JOIN fm USING (bundle_id)""")
def q_stream_bundles(spark, sf_dir):
    """S3: T1's flushes written as bundle documents by the stream's sink and read
    back by S4, a row for each pattern."""
    from tracefold.streaming.bundle_sink import bundle_sink, read_sink
    base, _ = _run_flush(spark, sf_dir, foreach=lambda batch, i, path: bundle_sink(path, "agent")(batch, i))
    b, _ = SB.read_bundles(read_sink(spark, f"{base}/upsert", "agent"))
    return b.select("id", F.col("windowStart").alias("window_start"), F.col("windowEnd").alias("window_end"),
                    F.array_join("affectedServices", ",").alias("affected_services"), "flush_metadata.reason",
                    "flush_metadata.log_count", "flush_metadata.flushed_at",
                    F.posexplode("logPatterns").alias("ord", "p")).select(
        "id", "window_start", "window_end", "affected_services", "reason", "log_count", "flushed_at",
        F.col("ord").cast("long").alias("ord"), "p.pattern", "p.count", "p.severity")

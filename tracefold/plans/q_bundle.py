"""Registered queries: bundle assembly (events, metrics, sequence, summaries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions.time import iso_seconds
from tracefold.operators import bundle as B
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.registry import register

_B = "WITH " + O.patterns_b_ctes() + O.graph_ctes() + O.bundle_ctes()


@register("J9_attach_events", _B + f"""
SELECT bundle_id, id, type, service, {O.iso_s('ts')} AS ts FROM ev_b""")
def q_attach_events(spark, sf_dir):
    e = FL.events_b(spark, sf_dir)
    return e.select("bundle_id", "id", "type", "service", iso_seconds(F.col("ts")).alias("ts"))


@register("G4_zscore_metrics", _B + """
SELECT bundle_id, round(cpu_z, 6) AS cpu_z, round(mem_z, 6) AS mem_z, round(latency_z, 6) AS latency_z,
  round(error_rate_z, 6) AS error_rate_z FROM metrics""")
def q_zscore_metrics(spark, sf_dir):
    m = FL.metrics_b(spark, sf_dir)
    return m.select("bundle_id", *[F.round(c, 6).alias(c) for c in ("cpu_z", "mem_z", "latency_z", "error_rate_z")])


@register("P8_flag_anomalies", _B + """
SELECT bundle_id, metric, text FROM anomalies""")
def q_flag_anomalies(spark, sf_dir):
    return B.flag_anomalies(FL.metrics_b(spark, sf_dir)).select("bundle_id", "metric", "text")


@register("W6_sequence_index", _B + """,
seq AS (SELECT bundle_id, first_ts AS ts, 'log' AS type, pattern_key AS item_id FROM patterns_b
  UNION ALL SELECT bundle_id, ts, 'event', id FROM ev_b)
SELECT bundle_id, type, item_id,
  row_number() OVER (PARTITION BY bundle_id ORDER BY ts ASC NULLS FIRST, type, item_id) - 1 AS sequence_index
FROM seq""")
def q_sequence_index(spark, sf_dir):
    s = B.sequence_index(FL.patterns_b(spark, sf_dir), FL.events_b(spark, sf_dir))
    return s.select("bundle_id", "type", "item_id", "sequence_index")


_P9 = _B + """,
root AS (SELECT bundle_id, coalesce(
  arg_min(node, position) FILTER (WHERE contains(lower(node), 'application') OR lower(node) IN ('app', 'main')),
  arg_max(node, position)) AS root_service FROM nodes GROUP BY bundle_id),
chain AS (SELECT bundle_id, list(node ORDER BY position) AS dependency_chain FROM nodes GROUP BY bundle_id),
aff AS (SELECT bundle_id, list_sort(list_distinct(list(""" + O.clean_service_sql("container") + """)))
  AS affected_services FROM patterns_b WHERE container IS NOT NULL AND container <> ''
  AND error_class IN ('ERROR', 'WARNING') GROUP BY bundle_id),
ecl AS (SELECT bundle_id, list_slice(list_sort(list_distinct(list(error_class))), 1, 5) AS error_classes
  FROM patterns_b GROUP BY bundle_id),
htop AS (SELECT bundle_id, arg_max(pattern, struct_pack(c := count, o := -first_entry_no)) AS top_pattern
  FROM patterns_b WHERE error_class IN ('ERROR', 'FATAL', 'EXCEPTION') GROUP BY bundle_id),
hint AS (SELECT bundle_id, CASE
  WHEN contains(lower(top_pattern), '404') OR contains(lower(top_pattern), 'not found')
    THEN 'HTTP 404 errors detected - possible missing endpoint or route'
  WHEN contains(lower(top_pattern), 'connection') AND (contains(lower(top_pattern), 'pool')
    OR contains(lower(top_pattern), 'exhaust')) THEN 'Database connection pool issues detected'
  WHEN contains(lower(top_pattern), 'timeout') THEN 'Timeout errors detected - possible performance or network issues'
  WHEN contains(lower(top_pattern), 'memory') OR contains(lower(top_pattern), 'oom')
    THEN 'Memory issues detected - possible memory leak or insufficient resources'
  ELSE 'Primary error: ' || substr(top_pattern, 1, 100) END AS hint FROM htop),
tp0 AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY """ + O.severity_score_sql(
    "pattern", "error_class", "summary") + """ DESC, count DESC, """ + O.PORDER + """) AS priority FROM patterns_b),
tp AS (SELECT bundle_id, list(printf('Log pattern (%dx): %s', count, substr(pattern, 1, 500)) ORDER BY priority)
  AS tp FROM tp0 WHERE priority <= 3 GROUP BY bundle_id),
an AS (SELECT bundle_id, string_agg(text, '; ' ORDER BY ord) AS an FROM anomalies GROUP BY bundle_id),
ev5 AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ts ASC NULLS FIRST, id) AS r FROM ev_b),
evs AS (SELECT bundle_id, list_sort(list_distinct(list(type))) AS ev_types,
  list_sort(list_distinct(list(reason))) AS ev_reasons FROM ev5 WHERE r <= 5 GROUP BY bundle_id),
allb AS (SELECT DISTINCT bundle_id FROM patterns_b),
parts AS (SELECT b.bundle_id, list_filter([
    CASE WHEN root_service IS NOT NULL AND root_service <> '' THEN 'Root service: ' || root_service END,
    CASE WHEN len(affected_services) > 0 THEN 'Affected services: ' ||
      array_to_string(list_slice(affected_services, 1, 5), ', ') END,
    CASE WHEN len(error_classes) > 0 THEN 'Error classes: ' || array_to_string(list_slice(error_classes, 1, 5), ', ')
      END] || coalesce(tp, []) || [
    CASE WHEN an IS NOT NULL THEN 'Anomalies: ' || an END,
    CASE WHEN len(ev_types) > 0 THEN 'Event types: ' || array_to_string(ev_types, ', ') END,
    CASE WHEN len(ev_reasons) > 0 THEN 'Event reasons: ' || array_to_string(ev_reasons, ', ') END,
    CASE WHEN hint IS NOT NULL AND hint <> '' THEN 'Hint: ' || hint END,
    CASE WHEN len(dependency_chain) > 0 THEN 'Dependency chain: ' ||
      array_to_string(list_slice(dependency_chain, 1, 5), ' → ') END], lambda x: x IS NOT NULL) AS parts
  FROM allb b LEFT JOIN root USING (bundle_id) LEFT JOIN aff USING (bundle_id) LEFT JOIN ecl USING (bundle_id)
  LEFT JOIN hint USING (bundle_id) LEFT JOIN chain USING (bundle_id) LEFT JOIN tp USING (bundle_id)
  LEFT JOIN an USING (bundle_id) LEFT JOIN evs USING (bundle_id)),
summ AS (SELECT bundle_id, array_to_string(parts, ' | ') AS s FROM parts)"""


@register("P9_summarize_bundles", _P9 + """
SELECT bundle_id, CASE WHEN length(s) > 5000 THEN substr(s, 1, 5000) || '...' ELSE s END AS summary FROM summ""")
def q_summarize_bundles(spark, sf_dir):
    return FL.summaries_b(spark, sf_dir)


@register("A10_assemble_bundles", _B + """,
np AS (SELECT bundle_id, count(*) AS n_patterns FROM patterns_b GROUP BY bundle_id),
ne AS (SELECT bundle_id, count(*) AS n_events FROM ev_b GROUP BY bundle_id),
nn AS (SELECT bundle_id, count(*) AS n_nodes FROM nodes GROUP BY bundle_id)
SELECT np.bundle_id, 'incident_' || substr(sha256(np.bundle_id), 1, 16) AS id, n_patterns,
  coalesce(n_events, 0) AS n_events, coalesce(n_nodes, 0) AS n_nodes, n_patterns + coalesce(n_events, 0) AS n_sequence
FROM np LEFT JOIN ne USING (bundle_id) LEFT JOIN nn USING (bundle_id)""")
def q_assemble_bundles(spark, sf_dir):
    b = FL.assembled_b(spark, sf_dir)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return b.select("bundle_id", "id", size("logPatterns").alias("n_patterns"), size("events").alias("n_events"),
                    size("dependencyGraph").alias("n_nodes"), size("sequence").alias("n_sequence"))


@register("S3_write_bundles")
def q_write_bundles(spark, sf_dir):
    """The sink's documents, read back from its files and keyed by their id."""
    import uuid

    from tracefold.session import delete_on_exit, ensure_checkpoint_dir
    from tracefold.sources.bundles import write_bundles
    path = delete_on_exit(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/bundles-{uuid.uuid4().hex[:12]}")
    write_bundles(FL.assembled_b(spark, sf_dir), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.bundle.id").alias("id"), F.col("value").alias("json"))


@register("S4_read_bundles", _B + f"""
SELECT 'incident_' || substr(sha256(bundle_id), 1, 16) AS id, CAST(pattern_ord AS BIGINT) AS ord, pattern, count,
  {O.iso_s('first_ts')} AS firstOccurrence, {O.iso_s('last_ts')} AS lastOccurrence, error_class AS severity,
  {O.clean_service_sql('container')} AS affectedService FROM patterns_b""")
def q_read_bundles(spark, sf_dir):
    from tracefold.sources.bundles import bundles_to_json, explode_bundles, read_bundles
    docs = bundles_to_json(FL.assembled_b(spark, sf_dir))
    bundles, _ = read_bundles(docs)
    p = explode_bundles(bundles)["patterns"]
    return p.select("id", "ord", "pattern", "count", "firstOccurrence", "lastOccurrence", "severity",
                    F.array_join("affectedService", ",").alias("affectedService"))

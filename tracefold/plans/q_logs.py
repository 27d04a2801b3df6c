"""Registered queries over the derived log fixture: parsing, patterns, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions.time import iso_seconds
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.registry import register

GAP = FL.FIXTURE_GAP_SECONDS


@register("P2_fold_entries", O.entries_ctes() and ("WITH " + O.entries_ctes() + """
SELECT source_id, CAST(entry_no AS BIGINT) AS entry_no, """ + O.iso_s("ts") + """ AS ts, level, message, container
FROM entries"""))
def q_fold_entries(spark, sf_dir):
    e = FL.entries_b(spark, sf_dir)
    return e.select("source_id", "entry_no", iso_seconds(F.col("ts")).alias("ts"), "level", "message", "container")


@register("A2_dedup_patterns", "WITH " + O.patterns_b_ctes() + """
SELECT bundle_id, pattern_key, pattern, count, """ + O.iso_s("first_ts") + """ AS first_ts, """
          + O.iso_s("last_ts") + """ AS last_ts, error_class, container, CAST(pattern_ord AS BIGINT) AS pattern_ord
FROM patterns_b""")
def q_dedup_patterns(spark, sf_dir):
    p = FL.patterns_b(spark, sf_dir)
    return p.select("bundle_id", "pattern_key", "pattern", "count", iso_seconds(F.col("first_ts")).alias("first_ts"),
                    iso_seconds(F.col("last_ts")).alias("last_ts"), "error_class", "container", "pattern_ord")


@register("W2_cluster_by_gap", "WITH " + O.clusters_ctes(GAP) + """
SELECT bundle_id, pattern_key, cluster_no, """ + O.iso_s("first_ts") + """ AS first_ts FROM clustered""")
def q_cluster_by_gap(spark, sf_dir):
    c = FL.clustered_b(spark, sf_dir)
    return c.select("bundle_id", "pattern_key", "cluster_no", iso_seconds(F.col("first_ts")).alias("first_ts"))


@register("W3_rank_root_causes", "WITH " + O.causes_ctes(GAP) + """
SELECT bundle_id, cluster_no, CAST(rank AS BIGINT) AS rank, pattern_key, pattern,
  CAST(severity_score AS BIGINT) AS severity_score, dependency_score, reason FROM causes""")
def q_rank_root_causes(spark, sf_dir):
    r = FL.causes_b(spark, sf_dir)
    return r.select("bundle_id", "cluster_no", "rank", "pattern_key", "pattern",
                    F.col("severity_score").cast("long").alias("severity_score"), "dependency_score", "reason")


# --- variant A ---------------------------------------------------------------

@register("P1_parse_lines", "WITH " + O.parsed_a_ctes() + """
SELECT source_id, line_no, """ + O.iso_us("ts") + """ AS ts, severity, norm, src_file, src_line FROM parsed""")
def q_parse_lines(spark, sf_dir):
    from tracefold.functions.time import iso_micros
    p = FL.parsed_a(spark, sf_dir)
    return p.select("source_id", "line_no", iso_micros(F.col("ts")).alias("ts"), "severity", "norm",
                    "src_file", "src_line")


@register("A1_aggregate_patterns", "WITH " + O.patterns_a_ctes() + """
SELECT bundle_id, norm, pattern, count, """ + O.iso_us("first_ts") + " AS first_ts, " + O.iso_us("last_ts")
          + """ AS last_ts, severity, first_line_no FROM patterns_a""")
def q_aggregate_patterns(spark, sf_dir):
    from tracefold.functions.time import iso_micros
    p = FL.patterns_a(spark, sf_dir)
    return p.select("bundle_id", "norm", "pattern", "count", iso_micros(F.col("first_ts")).alias("first_ts"),
                    iso_micros(F.col("last_ts")).alias("last_ts"), "severity", "first_line_no")


@register("A4_error_rate", "WITH " + O.parsed_a_ctes() + """
SELECT bundle_id, CAST(count_if(severity IN ('ERROR', 'FATAL', 'EXCEPTION')) AS BIGINT) AS error_count,
  count(*) AS line_count,
  CASE WHEN count(*) > 0 THEN count_if(severity IN ('ERROR', 'FATAL', 'EXCEPTION')) / count(*) * 10.0 ELSE 0.0 END
    AS error_rate_z
FROM parsed GROUP BY bundle_id""")
def q_error_rate(spark, sf_dir):
    from tracefold.operators.patterns import error_rate
    return error_rate(FL.parsed_a(spark, sf_dir))


@register("A7_ingest_stats", "WITH " + O.patterns_a_ctes() + """
SELECT bundle_id, count(*) AS pattern_count,
  CAST(count_if(severity IN ('ERROR', 'FATAL', 'EXCEPTION')) AS BIGINT) AS error_count
FROM patterns_a GROUP BY bundle_id""")
def q_ingest_stats(spark, sf_dir):
    from tracefold.operators.patterns import ingest_stats
    return ingest_stats(FL.patterns_a(spark, sf_dir))


@register("W8_derive_hint", "WITH " + O.patterns_a_ctes() + """,
top AS (SELECT bundle_id, arg_max(pattern, struct_pack(c := count, o := -first_line_no)) AS top_pattern
  FROM patterns_a WHERE severity IN ('ERROR', 'FATAL', 'EXCEPTION') GROUP BY bundle_id)
SELECT bundle_id, CASE
  WHEN contains(lower(top_pattern), '404') OR contains(lower(top_pattern), 'not found')
    THEN 'HTTP 404 errors detected - possible missing endpoint or route'
  WHEN contains(lower(top_pattern), 'connection') AND (contains(lower(top_pattern), 'pool')
    OR contains(lower(top_pattern), 'exhaust')) THEN 'Database connection pool issues detected'
  WHEN contains(lower(top_pattern), 'timeout') THEN 'Timeout errors detected - possible performance or network issues'
  WHEN contains(lower(top_pattern), 'memory') OR contains(lower(top_pattern), 'oom')
    THEN 'Memory issues detected - possible memory leak or insufficient resources'
  ELSE 'Primary error: ' || substr(top_pattern, 1, 100) END AS hint
FROM top""")
def q_derive_hint(spark, sf_dir):
    from tracefold.operators.patterns import derive_hint
    return derive_hint(FL.patterns_a(spark, sf_dir))


@register("W10_infer_service", "WITH " + O.parsed_a_ctes() + """
SELECT bundle_id, lower(arg_min(regexp_extract(line, 'com\\.(\\w+)\\.(\\w+)', 2), line_no)) AS service
FROM parsed WHERE regexp_matches(line, 'com\\.(\\w+)\\.(\\w+)') GROUP BY bundle_id""")
def q_infer_service(spark, sf_dir):
    from tracefold.operators.patterns import infer_service
    return infer_service(FL.parsed_a(spark, sf_dir))


# --- segments, lookback, windows, cluster ranking -----------------------------

LOOKBACK = FL.FIXTURE_LOOKBACK_SECONDS

_W1_SQL = "WITH " + O.entries_ctes() + f""",
w1a AS (SELECT *, CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY entry_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END
    AS segment FROM entries),
w1e AS (SELECT source_id, segment, ts AS error_ts, entry_no AS err_no FROM w1a WHERE level = 'ERROR')
SELECT source_id, segment, entry_no, level, {O.iso_s('ts')} AS ts, {O.iso_s('error_ts')} AS error_ts
FROM w1a JOIN w1e USING (source_id, segment)
WHERE entry_no = err_no OR ts >= error_ts - INTERVAL {LOOKBACK} SECOND"""


@register("W1_flush_segments", _W1_SQL)
def q_flush_segments(spark, sf_dir):
    s = FL.segments_b(spark, sf_dir)
    return s.select("source_id", "segment", "entry_no", "level", iso_seconds(F.col("ts")).alias("ts"),
                    iso_seconds(F.col("error_ts")).alias("error_ts"))


_J1_SQL = "WITH " + O.entries_ctes() + f""",
be AS (SELECT *, coalesce(strftime(ts, '%Y-%m-%d %H'), 'none') AS batch_id FROM entries),
j1s AS (SELECT source_id, batch_id, arg_min(ts, entry_no) FILTER (WHERE level = 'ERROR') AS first_error_ts,
    max(entry_no) AS last_no FROM be GROUP BY source_id, batch_id)
SELECT e.source_id, s.batch_id, e.entry_no, e.level, {O.iso_s('e.ts')} AS ts,
  {O.iso_s('s.first_error_ts')} AS first_error_ts
FROM j1s s JOIN be e ON e.source_id = s.source_id AND e.entry_no <= s.last_no
  AND e.ts >= s.first_error_ts - INTERVAL {LOOKBACK} SECOND"""


@register("J1_error_lookback", _J1_SQL)
def q_error_lookback(spark, sf_dir):
    from tracefold.operators.correlate import error_lookback
    j = error_lookback(FL.hour_batches(FL.entries_b(spark, sf_dir)), lookback_seconds=LOOKBACK)
    return j.select("source_id", "batch_id", "entry_no", "level", iso_seconds(F.col("ts")).alias("ts"),
                    iso_seconds(F.col("first_error_ts")).alias("first_error_ts"))


@register("A3_bundle_window", "WITH " + O.patterns_b_ctes() + f"""
SELECT bundle_id, {O.iso_s('min(first_ts)')} AS window_start, {O.iso_s('max(last_ts)')} AS window_end
FROM patterns_b GROUP BY bundle_id""")
def q_bundle_window(spark, sf_dir):
    from tracefold.operators.patterns import bundle_window
    w = bundle_window(FL.patterns_b(spark, sf_dir))
    return w.select("bundle_id", iso_seconds(F.col("window_start")).alias("window_start"),
                    iso_seconds(F.col("window_end")).alias("window_end"))


@register("A5_affected_services", "WITH " + O.patterns_b_ctes() + f"""
SELECT bundle_id, array_to_string(list_sort(list_distinct(list({O.clean_service_sql('container')}))), ',')
  AS affected_services
FROM patterns_b WHERE container IS NOT NULL AND container <> '' AND error_class IN ('ERROR', 'WARNING')
GROUP BY bundle_id""")
def q_affected_services(spark, sf_dir):
    from tracefold.operators.patterns import affected_services
    a = affected_services(FL.patterns_b(spark, sf_dir))
    return a.select("bundle_id", F.array_join("affected_services", ",").alias("affected_services"))


@register("A6_error_classes", "WITH " + O.patterns_b_ctes() + """
SELECT bundle_id, array_to_string(list_slice(list_sort(list_distinct(list(error_class))), 1, 5), ',')
  AS error_classes
FROM patterns_b GROUP BY bundle_id""")
def q_error_classes(spark, sf_dir):
    from tracefold.operators.patterns import error_classes
    a = error_classes(FL.patterns_b(spark, sf_dir))
    return a.select("bundle_id", F.array_join("error_classes", ",").alias("error_classes"))


@register("A2b_dedup_escalate", ("WITH " + O.patterns_b_ctes()).replace(
    "arg_min(level, entry_no) AS error_class",
    "CASE WHEN bool_or(level = 'ERROR') THEN 'ERROR' ELSE arg_min(level, entry_no) END AS error_class") + """
SELECT bundle_id, pattern_key, count, error_class FROM patterns_b""")
def q_dedup_escalate(spark, sf_dir):
    p = FL.patterns_b(spark, sf_dir, escalate=True)
    return p.select("bundle_id", "pattern_key", "count", "error_class")


@register("W4_rank_clusters", "WITH " + O.causes_ctes(GAP) + """,
cl AS (SELECT DISTINCT bundle_id, cluster_no FROM clustered),
w4 AS (SELECT cl.bundle_id, cl.cluster_no, CAST(coalesce(c.severity_score, 0) AS BIGINT) AS top_severity
  FROM cl LEFT JOIN (SELECT * FROM causes WHERE rank = 1) c
  ON cl.bundle_id = c.bundle_id AND cl.cluster_no = c.cluster_no)
SELECT bundle_id, cluster_no, top_severity,
  row_number() OVER (PARTITION BY bundle_id ORDER BY top_severity DESC, cluster_no) AS cluster_rank FROM w4""")
def q_rank_clusters(spark, sf_dir):
    from tracefold.operators.correlate import rank_clusters, rank_root_causes
    cl = FL.clustered_b(spark, sf_dir)
    return rank_clusters(cl, rank_root_causes(cl)).select("bundle_id", "cluster_no", "top_severity", "cluster_rank")


@register("J8_effects", "WITH " + O.causes_ctes(GAP) + """
SELECT bundle_id, cluster_no, pattern_key FROM clustered c
WHERE NOT EXISTS (SELECT 1 FROM causes r WHERE r.bundle_id = c.bundle_id AND r.cluster_no = c.cluster_no
  AND r.pattern = c.pattern)""")
def q_effects(spark, sf_dir):
    from tracefold.operators.correlate import effects, rank_root_causes
    cl = FL.clustered_b(spark, sf_dir)
    return effects(cl, rank_root_causes(cl)).select("bundle_id", "cluster_no", "pattern_key")


@register("W5_prioritize_patterns", "WITH " + O.patterns_b_ctes() + f""",
pr AS (SELECT *, {O.severity_score_sql('pattern', 'error_class', 'prompt')} AS priority_score FROM patterns_b),
pr2 AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY priority_score DESC, count DESC, {O.PORDER})
  AS priority FROM pr)
SELECT bundle_id, pattern_key, CAST(priority_score AS BIGINT) AS priority_score, priority FROM pr2
WHERE priority <= 20""")
def q_prioritize_patterns(spark, sf_dir):
    from tracefold.operators.correlate import prioritize_patterns
    p = prioritize_patterns(FL.patterns_b(spark, sf_dir), limit=20, keyword_set="prompt")
    return p.select("bundle_id", "pattern_key", F.col("priority_score").cast("long").alias("priority_score"),
                    "priority")

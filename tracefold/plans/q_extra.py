"""Registered queries: event/metric service extraction (P6, P7), the detailed
summary (P10), code snippets (J3) and the as-of recent
commit (J10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.time import iso_seconds
from tracefold.operators import bundle as B
from tracefold.operators import depgraph as G
from tracefold.operators import patterns as A
from tracefold.operators.parse import STACK_FILE_RE
from tracefold.operators.scan import numeric_bucket, running_sum
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.registry import register
from tracefold.session import table

_B = "WITH " + O.patterns_b_ctes() + O.graph_ctes() + O.bundle_ctes()

# --- P6 / P7 ------------------------------------------------------------------------

_CALL = G.EVENT_CALL_RE.replace("'", "''")


@register("P6_event_services", _B + f""",
ev_names AS (SELECT bundle_id, unnest([service, CASE WHEN regexp_extract(reason, '{_CALL}', 1) <> ''
    THEN regexp_extract(reason, '{_CALL}', 1) END,
  CASE WHEN length({O.clean_service_sql("coalesce(pod, '')")}) > 2 THEN {O.clean_service_sql("coalesce(pod, '')")} END]
  || {O.mentions_sql('reason')}) AS service FROM ev_b)
SELECT DISTINCT bundle_id, service FROM ev_names WHERE service IS NOT NULL""")
def q_event_services(spark, sf_dir):
    services, _ = G.extract_event_services(FL.events_b(spark, sf_dir))
    return services.select("bundle_id", "service")


@register("P6b_event_edges", _B + f"""
SELECT bundle_id, service AS caller, regexp_extract(reason, '{_CALL}', 1) AS callee, substr(reason, 1, 100) AS evidence,
  CAST(0.9 AS DOUBLE) AS confidence FROM ev_b WHERE regexp_extract(reason, '{_CALL}', 1) <> '' AND service IS NOT NULL
  AND service <> ''""")
def q_event_edges(spark, sf_dir):
    _, edges = G.extract_event_services(FL.events_b(spark, sf_dir))
    return edges.select("bundle_id", "caller", "callee", "evidence", "confidence")


def metric_labels(spark, sf_dir) -> DataFrame:
    """Metric rows with their service labels (service, container, deployment)."""
    m = FL.metrics_b(spark, sf_dir)
    return m.select("bundle_id", "service", F.concat("service", F.lit("-7d4f8b-xkz2p")).alias("container"),
                    F.lit(None).cast("string").alias("service_name"), F.col("service").alias("deployment"),
                    F.lit(None).cast("string").alias("pod"))


@register("P7_metric_services", _B + """
SELECT DISTINCT bundle_id, service FROM (
  SELECT bundle_id, unnest([service, service || '-7d4f8b-xkz2p', service]) AS service FROM metrics)""")
def q_metric_services(spark, sf_dir):
    return G.extract_metric_services(metric_labels(spark, sf_dir)).select("bundle_id", "service")


# --- P10 detailed summary -------------------------------------------------------------

DETAIL_PATTERNS, DETAIL_EVENTS, DETAIL_CHARS = 5, 5, 1000
DETAIL_LABELS = [("cpu_z", "CPU"), ("mem_z", "Memory"), ("latency_z", "Latency"), ("error_rate_z", "Error Rate")]


def summarize_detailed(spark, sf_dir) -> DataFrame:
    """P10: the multi-line prompt summary; patterns and events in input order."""
    pats, _, _, nodes = FL.graph_b(spark, sf_dir)
    win = A.bundle_window(pats)
    root = G.root_service(nodes)
    aff = A.affected_services(pats)
    hint = A.derive_hint(pats, level="error_class", ord_col="first_entry_no")
    chain = nodes.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node"))),
                                                       lambda s: s["node"]).alias("chain"))
    pl = (pats.where(F.col("pattern_ord") < DETAIL_PATTERNS).groupBy("bundle_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pattern_ord", F.format_string(
            "  - (%dx)%s: %s", F.col("count"),
            F.when(F.coalesce(F.col("error_class"), F.lit("")) != "",
                   F.concat(F.lit(" ["), F.col("error_class"), F.lit("]")))
            .otherwise(F.lit("")), F.substring("pattern", 1, DETAIL_CHARS)).alias("t")))),
            lambda s: s["t"]).alias("pat_lines")))
    ev = FL.events_b(spark, sf_dir)
    w = Window.partitionBy("bundle_id").orderBy(F.col("ts").asc_nulls_first(), "id")
    el = (ev.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= DETAIL_EVENTS).groupBy("bundle_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__r", F.concat(
            F.lit("  - ["), F.col("type"), F.lit("] "), F.col("reason"),
            F.when(F.coalesce(F.col("pod"), F.lit("")) != "", F.concat(F.lit(" (pod: "), F.col("pod"), F.lit(")")))
            .otherwise(F.lit(""))).alias("t")))), lambda s: s["t"]).alias("ev_lines")))
    met = FL.metrics_b(spark, sf_dir)
    ml = met.select("bundle_id", F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.format_string(f"  - {lbl} Z-score: %.2f", F.col(c)))
        for c, lbl in DETAIL_LABELS])).alias("met_lines"))
    b = (win.join(root, "bundle_id", "left").join(aff, "bundle_id", "left").join(hint, "bundle_id", "left")
         .join(chain, "bundle_id", "left").join(pl, "bundle_id", "left").join(el, "bundle_id", "left")
         .join(ml, "bundle_id", "left"))
    empty = F.array().cast("array<string>")
    nonempty = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    lines = F.concat(
        F.array(F.concat(F.lit("Correlation Window: "), iso_seconds(F.col("window_start")), F.lit(" to "),
                         iso_seconds(F.col("window_end")))),
        F.when(F.coalesce(F.col("root_service"), F.lit("")) != "",
               F.array(F.concat(F.lit("Identified Root Service: "), F.col("root_service")))).otherwise(empty),
        F.when(nonempty("affected_services"), F.array(F.concat(F.lit("Affected Services: "),
                                                                F.array_join("affected_services", ", "))))
        .otherwise(empty),
        F.when(nonempty("pat_lines"), F.concat(F.array(F.lit("\nLog Patterns:")), F.col("pat_lines"))).otherwise(empty),
        F.when(nonempty("ev_lines"), F.concat(F.array(F.lit("\nKey Events:")), F.col("ev_lines"))).otherwise(empty),
        F.array(F.lit("\nMetric Anomalies:")), F.coalesce(F.col("met_lines"), empty),
        F.when(nonempty("chain"), F.array(F.concat(F.lit("\nDependency Chain: "), F.array_join("chain", " → "))))
        .otherwise(empty),
        F.when(F.coalesce(F.col("hint"), F.lit("")) != "",
               F.array(F.concat(F.lit("\nDerived Root Cause Hint: "), F.col("hint")))).otherwise(empty))
    return b.select("bundle_id", F.array_join(lines, "\n").alias("summary"))


_P10 = _B + """,
root AS (SELECT bundle_id, coalesce(
  arg_min(node, position) FILTER (WHERE contains(lower(node), 'application') OR lower(node) IN ('app', 'main')),
  arg_max(node, position)) AS root_service FROM nodes GROUP BY bundle_id),
chain AS (SELECT bundle_id, list(node ORDER BY position) AS chain FROM nodes GROUP BY bundle_id),
aff AS (SELECT bundle_id, list_sort(list_distinct(list(""" + O.clean_service_sql("container") + """)))
  AS affected_services FROM patterns_b WHERE container IS NOT NULL AND container <> ''
  AND error_class IN ('ERROR', 'WARNING') GROUP BY bundle_id),
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
pl AS (SELECT bundle_id, list(printf('  - (%dx)%s: %s', count, CASE WHEN coalesce(error_class, '') <> '' THEN
    ' [' || error_class || ']' ELSE '' END, substr(pattern, 1, 1000)) ORDER BY pattern_ord) AS pat_lines
  FROM patterns_b WHERE pattern_ord < 5 GROUP BY bundle_id),
ev5 AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ts ASC NULLS FIRST, id) AS r FROM ev_b),
el AS (SELECT bundle_id, list('  - [' || type || '] ' || reason || CASE WHEN coalesce(pod, '') <> '' THEN
    ' (pod: ' || pod || ')' ELSE '' END ORDER BY r) AS ev_lines FROM ev5 WHERE r <= 5 GROUP BY bundle_id),
ml AS (SELECT bundle_id, list_filter([
    CASE WHEN coalesce(cpu_z, 0) <> 0 THEN printf('  - CPU Z-score: %.2f', cpu_z) END,
    CASE WHEN coalesce(mem_z, 0) <> 0 THEN printf('  - Memory Z-score: %.2f', mem_z) END,
    CASE WHEN coalesce(latency_z, 0) <> 0 THEN printf('  - Latency Z-score: %.2f', latency_z) END,
    CASE WHEN coalesce(error_rate_z, 0) <> 0 THEN printf('  - Error Rate Z-score: %.2f', error_rate_z) END],
  lambda x: x IS NOT NULL) AS met_lines FROM metrics)
SELECT w.bundle_id, array_to_string(
  ['Correlation Window: ' || """ + O.iso_s("w.window_start") + """ || ' to ' || """ + O.iso_s("w.window_end") + """]
  || CASE WHEN coalesce(root_service, '') <> '' THEN ['Identified Root Service: ' || root_service] ELSE [] END
  || CASE WHEN len(affected_services) > 0 THEN ['Affected Services: ' || array_to_string(affected_services, ', ')]
     ELSE [] END
  || CASE WHEN len(pat_lines) > 0 THEN [chr(10) || 'Log Patterns:'] || pat_lines ELSE [] END
  || CASE WHEN len(ev_lines) > 0 THEN [chr(10) || 'Key Events:'] || ev_lines ELSE [] END
  || [chr(10) || 'Metric Anomalies:'] || coalesce(met_lines, [])
  || CASE WHEN len(chain) > 0 THEN [chr(10) || 'Dependency Chain: ' || array_to_string(chain, ' → ')] ELSE [] END
  || CASE WHEN coalesce(hint, '') <> '' THEN [chr(10) || 'Derived Root Cause Hint: ' || hint] ELSE [] END,
  chr(10)) AS summary
FROM win w LEFT JOIN root USING (bundle_id) LEFT JOIN aff USING (bundle_id) LEFT JOIN hint USING (bundle_id)
  LEFT JOIN chain USING (bundle_id) LEFT JOIN pl USING (bundle_id) LEFT JOIN el USING (bundle_id)
  LEFT JOIN ml USING (bundle_id)"""


@register("P10_summarize_detailed", _P10)
def q_summarize_detailed(spark, sf_dir):
    return summarize_detailed(spark, sf_dir)


# --- J3 code snippets -----------------------------------------------------------------

REPO_FILES = ["Main.java", "HikariPool.java", "README.md"]


def repo_lines(spark, sf_dir) -> DataFrame:
    """A source repository derived from ``documents``: every document's lines
    are appended to one of three files per language; file line numbers are
    a skew-safe running count in (doc_id, line) order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    idx = (F.col("doc_id") % len(REPO_FILES)).cast("int")
    base = F.element_at(F.array(*[F.lit(x) for x in REPO_FILES]), idx + 1)
    x = d.select(F.concat(F.lit("repo/"), F.col("lang"), F.lit("/src/"), base).alias("file_path"), "doc_id",
                 F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    x = running_sum(x, ["file_path"], ["doc_id", "pos"], F.lit(1), "line_no", numeric_bucket("doc_id", 1024))
    return x.select("file_path", "line_no", "text")


def _repo_sql() -> str:
    files = ", ".join(f"'{f}'" for f in REPO_FILES)
    return f""",
docs_l AS (SELECT 'repo/' || lang || '/src/' || [{files}][CAST(doc_id % {len(REPO_FILES)} AS INTEGER) + 1] AS file_path,
    doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
repo AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY doc_id, pos) AS line_no, text
  FROM docs_l)"""


@register("J3_attach_snippets", "WITH " + O.parsed_a_ctes() + _repo_sql() + """,
fr AS (SELECT bundle_id, src_file, arg_min(src_line, line_no) AS src_line, min(line_no) AS ord FROM parsed
  WHERE src_file IS NOT NULL GROUP BY bundle_id, src_file),
files AS (SELECT string_split(file_path, '/')[-1] AS base, min(file_path) AS file_path
  FROM (SELECT DISTINCT file_path FROM repo) GROUP BY base),
hit AS (SELECT fr.*, files.file_path FROM fr JOIN files ON fr.src_file = files.base),
snip AS (SELECT h.bundle_id, h.file_path, h.src_line, h.ord,
    string_agg(r.text || chr(10), '' ORDER BY r.line_no) AS content
  FROM hit h JOIN repo r ON r.file_path = h.file_path AND r.line_no BETWEEN h.src_line - 10 AND h.src_line + 10
  GROUP BY h.bundle_id, h.file_path, h.src_line, h.ord),
top AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ord) AS n FROM snip)
SELECT bundle_id, file_path, CAST(src_line AS INTEGER) AS src_line, CAST(greatest(1, src_line - 5) AS BIGINT)
  AS start_line, CAST(src_line + 10 AS BIGINT) AS end_line, content FROM top WHERE n <= 5""")
def q_attach_snippets(spark, sf_dir):
    parsed = FL.parsed_a(spark, sf_dir).select("bundle_id", F.col("line_no").alias("ord"), "src_file", "src_line")
    s = B.attach_snippets(parsed, repo_lines(spark, sf_dir))
    return s.select("bundle_id", "file_path", "src_line", "start_line", "end_line", "content")


# --- J10 recent commit ------------------------------------------------------------------

def commits(spark, sf_dir) -> DataFrame:
    """Commits derived from ``events``: every event is a commit touching one or
    both source files."""
    ev = table(spark, sf_dir, "events")
    idx = (F.col("event_id") % 3).cast("int")
    files = (F.when(idx == 0, F.array(F.lit("Main.java"))).when(idx == 1, F.array(F.lit("HikariPool.java")))
             .otherwise(F.array(F.lit("Main.java"), F.lit("HikariPool.java"))))
    return ev.select(F.md5(F.col("event_id").cast("string")).alias("commit_hash"),
                     F.col("ts").cast("timestamp").alias("ts"),
                     F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
                     F.concat(F.lit("change "), F.col("event_id").cast("string")).alias("message"),
                     files.alias("changed_files"))


@register("J10_recent_commit", "WITH " + O.patterns_b_ctes() + f""",
bf AS (SELECT DISTINCT bundle_id, unnest(regexp_extract_all(pattern, '{STACK_FILE_RE}', 3)) AS file FROM patterns_b),
bw AS (SELECT bundle_id, min(first_ts) AS incident_ts FROM patterns_b GROUP BY bundle_id),
f AS (SELECT bf.bundle_id, file, incident_ts FROM bf JOIN bw USING (bundle_id)),
c AS (SELECT md5(CAST(event_id AS VARCHAR)) AS commit_hash, ts,
    unnest(CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN ['Main.java'] WHEN 1 THEN ['HikariPool.java']
      ELSE ['Main.java', 'HikariPool.java'] END) AS file FROM events),
j AS (SELECT f.bundle_id, f.file, f.incident_ts, arg_max(c.commit_hash, struct_pack(t := c.ts, h := c.commit_hash))
    AS commit_hash, max(c.ts) AS commit_ts
  FROM f LEFT JOIN c ON c.file = f.file AND c.ts <= f.incident_ts GROUP BY f.bundle_id, f.file, f.incident_ts)
SELECT bundle_id, file, {O.iso_s('incident_ts')} AS incident_ts, commit_hash,
  strftime(commit_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS commit_ts FROM j""")
def q_recent_commit(spark, sf_dir):
    from tracefold.functions.time import iso_micros
    pats = FL.patterns_b(spark, sf_dir)
    files = (pats.select("bundle_id", F.explode(F.regexp_extract_all("pattern", F.lit(STACK_FILE_RE), 3)).alias("file"))
             .distinct().join(pats.groupBy("bundle_id").agg(F.min("first_ts").alias("incident_ts")), "bundle_id"))
    r = B.recent_commit(files, commits(spark, sf_dir))
    return r.select("bundle_id", "file", iso_seconds(F.col("incident_ts")).alias("incident_ts"), "commit_hash",
                    iso_micros(F.col("commit_ts")).alias("commit_ts"))

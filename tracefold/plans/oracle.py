"""DuckDB oracle SQL: CTE fragments that restate each operator in plain SQL.

The fragments are layered (fixture -> entries -> patterns -> clusters ...) and
each registered query appends its final SELECT.  Regex rules use RE2 syntax;
lookarounds are replaced by the guard-and-remove rewrite.
"""

from __future__ import annotations

from tracefold.functions import text as T
from tracefold.functions.time import HEAD_B_RE as HEAD_B
from tracefold.functions.time import TS_B_RE as TS_B
from tracefold.plans.fixture import log_lines_cte

NL = "chr(10)"


def contains_any(text_sql: str, words) -> str:
    return "(" + " OR ".join(f"contains({text_sql}, '{w}')" for w in words) + ")"


def severity_score_sql(pattern: str, severity: str, keyword_set: str = "correlator") -> str:
    crit, err, warn = T.SCORE_SETS[keyword_set]
    text = f"lower({pattern} || coalesce(' ' || {severity}, ''))"
    return (f"(CASE WHEN {contains_any(text, crit)} THEN 100 WHEN {contains_any(text, err)} THEN 80 "
            f"WHEN {contains_any(text, warn)} THEN 50 ELSE 10 END)")


def norm_b_sql(c: str) -> str:
    s = f"regexp_replace({c}, '(?i)\\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\\b', '<UUID>', 'g')"
    s = f"regexp_replace({s}, '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b', '<IP>', 'g')"
    s = f"regexp_replace({s}, '(?i)(?:user_?id|order_?id|request_?id|session_?id|id)[=:]\\s*\\w+', 'id=<ID>', 'g')"
    # (?<![:(])\b\d{6,}\b(?!\)) without lookaround: guard, replace, unguard.
    s = f"regexp_replace({s}, '([:(])(\\d{{6,}})\\b', '\\1zzq\\2', 'g')"
    s = f"regexp_replace({s}, '\\b(\\d{{6,}}\\))', 'zzq\\1', 'g')"
    s = f"regexp_replace({s}, '\\b\\d{{6,}}\\b', '<NUM>', 'g')"
    s = f"regexp_replace({s}, 'zzq', '', 'g')"
    s = f"regexp_replace({s}, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T\\s]\\d{{2}}:\\d{{2}}:\\d{{2}}', '<TS>', 'g')"
    return s


def level_b_sql(line: str) -> str:
    return (f"(CASE WHEN regexp_matches(upper({line}), '{T.LEVEL_B_ERROR_RE}') THEN 'ERROR' "
            f"WHEN regexp_matches(upper({line}), '{T.LEVEL_B_WARN_RE}') THEN 'WARNING' ELSE 'INFO' END)")


def clean_service_sql(c: str) -> str:
    return (f"regexp_replace(regexp_replace({c}, '{T.POD_HASH_SUFFIX_RE}', ''), "
            f"'{T.POD_ORDINAL_SUFFIX_RE}', '')")




def iso_s(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def iso_us(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ')"


# --- layered CTEs -----------------------------------------------------------

def entries_ctes() -> str:
    """P2 over the fixture -> ``entries(source_id, entry_no, ts, level, message, container)``."""
    return log_lines_cte() + f""",
nb AS (SELECT * FROM log_lines WHERE regexp_matches(line, '\\S')),
heads AS (SELECT *, max(CASE WHEN regexp_matches(line, '{HEAD_B}') THEN line_no END)
    OVER (PARTITION BY source_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry_no
  FROM nb),
entries0 AS (SELECT source_id, entry_no, string_agg(line, {NL} ORDER BY line_no) AS message,
    arg_min(container, line_no) AS container
  FROM heads WHERE entry_no IS NOT NULL GROUP BY source_id, entry_no),
entries AS (SELECT source_id, entry_no,
    try_strptime(regexp_extract(message, '{TS_B}', 1) || ' ' || regexp_extract(message, '{TS_B}', 2),
                 '%Y-%m-%d %H:%M:%S') AS ts,
    {level_b_sql(f"split_part(message, {NL}, 1)")} AS level, message, container
  FROM entries0)"""


def patterns_b_ctes(bundle: str = "day") -> str:
    """A2 over bundled entries -> ``patterns_b`` with sev_rank and pattern_ord."""
    if bundle == "day":
        bid = "source_id || '/' || coalesce(strftime(ts, '%Y-%m-%d'), 'none')"
    else:
        raise ValueError(bundle)
    return entries_ctes() + f""",
bentries AS (SELECT *, {bid} AS bundle_id FROM entries),
pk AS (SELECT *, md5({norm_b_sql('message')}) AS pattern_key FROM bentries),
patterns_b0 AS (SELECT bundle_id, pattern_key, arg_min(message, entry_no) AS pattern, count(*) AS count,
    arg_min(ts, entry_no) AS first_ts, arg_max(ts, entry_no) AS last_ts, arg_min(level, entry_no) AS error_class,
    arg_min(container, entry_no) AS container, min(entry_no) AS first_entry_no
  FROM pk GROUP BY bundle_id, pattern_key),
patterns_b1 AS (SELECT *, CASE error_class WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END
    AS sev_rank FROM patterns_b0),
patterns_b AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY sev_rank, count DESC, first_entry_no) - 1
    AS pattern_ord FROM patterns_b1)"""


PORDER = "sev_rank, count DESC, first_entry_no"


def clusters_ctes(gap_seconds: float, bundle: str = "day") -> str:
    """W2 over patterns_b -> ``clustered`` (adds cluster_no)."""
    gap_us = int(round(gap_seconds * 1_000_000))
    return patterns_b_ctes(bundle) + f""",
w2a AS (SELECT *, lag(first_ts) OVER (PARTITION BY bundle_id ORDER BY first_ts, {PORDER}) AS prev_ts
  FROM patterns_b WHERE first_ts IS NOT NULL),
w2b AS (SELECT *, CASE WHEN prev_ts IS NULL OR epoch_us(first_ts) - epoch_us(prev_ts) > {gap_us} THEN 1 ELSE 0 END
    AS flag FROM w2a),
w2n AS (SELECT bundle_id, count(*) AS n_null FROM patterns_b WHERE first_ts IS NULL GROUP BY bundle_id),
clustered AS (
  SELECT bundle_id, pattern_key, pattern, count, first_ts, last_ts, error_class, container, first_entry_no,
    sev_rank, pattern_ord,
    CAST(sum(flag) OVER (PARTITION BY bundle_id ORDER BY first_ts, {PORDER} ROWS BETWEEN UNBOUNDED PRECEDING
      AND CURRENT ROW) - 1 + coalesce(n_null, 0) AS BIGINT) AS cluster_no
  FROM w2b LEFT JOIN w2n USING (bundle_id)
  UNION ALL
  SELECT bundle_id, pattern_key, pattern, count, first_ts, last_ts, error_class, container, first_entry_no,
    sev_rank, pattern_ord,
    CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY {PORDER}) - 1 AS BIGINT) AS cluster_no
  FROM patterns_b WHERE first_ts IS NULL)"""


def reason_sql(sev: str, dep: str, cnt: str) -> str:
    parts = (f"concat_ws('; ', CASE WHEN {sev} >= 100 THEN 'CRITICAL/FATAL severity' WHEN {sev} >= 80 THEN "
             f"'ERROR level' WHEN {sev} >= 50 THEN 'WARNING level' END, CASE WHEN {dep} > 0 THEN "
             f"'deep in dependency chain (depth=' || CAST({dep} AS VARCHAR) || ')' END, CASE WHEN {cnt} > 1 THEN "
             f"'occurred ' || CAST({cnt} AS VARCHAR) || 'x' END)")
    return f"(CASE WHEN {parts} = '' THEN 'pattern detected' ELSE {parts} END)"


def causes_ctes(gap_seconds: float, dep_cte: str | None = None, bundle: str = "day") -> str:
    """W3 over clustered (optionally with a ``dep`` CTE giving dependency_score
    per (bundle_id, pattern_key)) -> ``causes``."""
    base = clusters_ctes(gap_seconds, bundle)
    if dep_cte:
        base += ",\n" + dep_cte.lstrip(",\n")
        dep_join = "LEFT JOIN dep USING (bundle_id, pattern_key)"
        dep_val = "coalesce(dep.dependency_score, 0)"
    else:
        dep_join, dep_val = "", "0"
    return base + f""",
scored AS (SELECT clustered.*, {severity_score_sql('pattern', 'error_class')} AS severity_score,
    CAST({dep_val} AS BIGINT) AS dependency_score FROM clustered {dep_join}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, cluster_no ORDER BY severity_score DESC,
    dependency_score DESC, first_ts ASC NULLS FIRST, {PORDER}) AS rank
  FROM scored WHERE severity_score >= 50 OR dependency_score > 0),
causes AS (SELECT *, {reason_sql('severity_score', 'dependency_score', 'count')} AS reason
  FROM ranked WHERE rank <= 5)"""


# --- variant A (line parser) -----------------------------------------------

def severity_a_sql(line: str) -> str:
    words = list(T.SEVERITY_KEYWORDS_A)
    br = f"upper(regexp_extract({line}, '\\[(\\w+)\\]', 1))"
    in_list = ", ".join(f"'{w}'" for w in words)
    scan = " ".join(f"WHEN contains(upper({line}), '{w}') THEN '{w}'" for w in words)
    return f"(CASE WHEN {br} IN ({in_list}) THEN {br} {scan} END)"


def norm_a_sql(line: str) -> str:
    from tracefold.functions.time import TS_A_PATTERNS
    s = line
    for p in TS_A_PATTERNS:
        s = f"regexp_replace({s}, '{p}', '', 'g')"
    for pat, rep in T.NORM_A_RULES:
        if pat.startswith(r"\b(?!"):
            # \b(?!404|...)\d+\b without lookahead: guard the kept codes, replace, unguard.
            codes = pat[len(r"\b(?!"):pat.index(")")]
            s = f"regexp_replace({s}, '\\b({codes})(\\d*)\\b', 'zzq\\1\\2', 'g')"
            s = f"regexp_replace({s}, '\\b\\d+\\b', '{rep}', 'g')"
            s = f"regexp_replace({s}, 'zzq', '', 'g')"
        else:
            s = f"regexp_replace({s}, '{pat}', '{rep}', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def ts_a_sql(line: str) -> str:
    def frac(sep: str) -> str:
        pat = f"(\\d{{4}}-\\d{{2}}-\\d{{2}}){sep}(\\d{{2}}:\\d{{2}}:\\d{{2}})\\.(\\d+)"
        d = f"regexp_extract({line}, '{pat}', 1)"
        t = f"regexp_extract({line}, '{pat}', 2)"
        f = f"rpad(substr(regexp_extract({line}, '{pat}', 3), 1, 6), 6, '0')"
        return f"(CASE WHEN {d} <> '' THEN try_strptime({d} || ' ' || {t} || '.' || {f}, '%Y-%m-%d %H:%M:%S.%f') END)"
    clf = f"regexp_extract({line}, '(\\d{{2}}/\\w{{3}}/\\d{{4}}:\\d{{2}}:\\d{{2}}:\\d{{2}})', 1)"
    clf_ts = f"(CASE WHEN {clf} <> '' THEN try_strptime({clf}, '%d/%b/%Y:%H:%M:%S') END)"
    return f"coalesce({frac('T')}, {frac(' ')}, {clf_ts})"


STACK_FILE = r"at\s+([\w.$]+)\.([\w$]+)\(([\w.]+):(\d+)\)"


def parsed_a_ctes() -> str:
    """P1 over the fixture; one bundle per source -> ``parsed``."""
    f3 = f"regexp_extract(line, '{STACK_FILE}', 3)"
    return log_lines_cte() + f""",
parsed AS (SELECT source_id AS bundle_id, source_id, line_no, line, {ts_a_sql('line')} AS ts,
    {severity_a_sql('line')} AS severity, {norm_a_sql('line')} AS norm,
    CASE WHEN {f3} <> '' THEN {f3} END AS src_file,
    CASE WHEN {f3} <> '' THEN CAST(regexp_extract(line, '{STACK_FILE}', 4) AS INTEGER) END AS src_line
  FROM log_lines WHERE regexp_matches(line, '\\S'))"""


def patterns_a_ctes() -> str:
    """A1 over parsed -> ``patterns_a``."""
    return parsed_a_ctes() + """,
patterns_a AS (SELECT bundle_id, norm, arg_min(substr(line, 1, 1000), line_no) AS pattern, count(*) AS count,
    min(ts) AS first_ts, max(ts) AS last_ts, arg_min(severity, line_no) AS severity, min(line_no) AS first_line_no
  FROM parsed GROUP BY bundle_id, norm)"""


# --- dependency graph ----------------------------------------------------------

def _q(s: str) -> str:
    return s.replace("'", "''")


def _any_sql(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{_q(m)}')" for m in markers) + ")"


def frame_lists_ctes(src: str = "patterns_b") -> str:
    """P3/P4 list columns per pattern -> ``frame_lists`` and ``frames``."""
    from tracefold.operators import depgraph as G
    cls, pth = G.FRAMEWORK_CLASS_MARKERS, G.FRAMEWORK_PATH_MARKERS

    def lst(rx, g=1):
        return f"regexp_extract_all(pattern, '{_q(rx)}', {g})"

    def st(lang, name):
        return f"{{'lang': '{lang}', 'name': {name}}}"

    return f""",
fl0 AS (SELECT bundle_id, pattern_key, pattern, {lst(G.NODE_FRAME_RE, 1)} AS node_f, {lst(G.NODE_FRAME_RE, 2)} AS node_p
  FROM {src}),
fl1 AS (SELECT bundle_id, pattern_key, pattern,
  list_transform(list_filter({lst(G.JAVA_FRAME_RE)}, lambda c: NOT {_any_sql('c', cls)}),
    lambda c: {st('java', "string_split(c, '.')[-1]")})
  || list_transform(list_filter({lst(G.PYTHON_FRAME_RE)}, lambda p: NOT {_any_sql('p', pth)}),
    lambda p: {st('python', "replace(string_split(p, '/')[-1], '.py', '')")})
  || list_transform(list_filter(generate_series(1, len(node_p)), lambda i: NOT {_any_sql('node_p[i]', pth)}),
    lambda i: {st('node', "CASE WHEN coalesce(node_f[i], '') <> '' THEN node_f[i] ELSE replace(replace(string_split(node_p[i], '/')[-1], '.js', ''), '.ts', '') END")})
  || list_transform(list_filter({lst(G.GO_FRAME_RE)}, lambda p: NOT {_any_sql('p', pth)}),
    lambda p: {st('go', "replace(string_split(p, '/')[-1], '.go', '')")})
  || list_transform(list_filter({lst(G.RUBY_FRAME_RE)}, lambda p: NOT {_any_sql('p', pth)}),
    lambda p: {st('ruby', "replace(string_split(p, '/')[-1], '.rb', '')")})
  || list_transform(list_filter({lst(G.DOTNET_FRAME_RE)}, lambda c: NOT {_any_sql('c', cls)}),
    lambda c: {st('dotnet', "string_split(c, '.')[-1]")}) AS allf,
  list_filter(list_transform(regexp_extract_all(pattern, '{_q(G.CAUSED_BY_RE)}', 1),
    lambda e: string_split(replace(replace(e, 'Exception', ''), 'Error', ''), '.')[-1]), lambda n: length(n) > 2)
    AS caused
  FROM fl0),
frame_lists AS (SELECT bundle_id, pattern_key, pattern, caused,
  list_filter(allf, lambda s, i: list_position(list_transform(allf, lambda t: t.name), s.name) = i) AS chain
  FROM fl1),
frames AS (SELECT bundle_id, pattern_key, CAST(pos AS BIGINT) AS pos, f.lang AS lang, f.name AS component FROM (
  SELECT bundle_id, pattern_key, unnest(chain) AS f, generate_subscripts(chain, 1) - 1 AS pos FROM frame_lists))"""


def mentions_sql(text: str) -> str:
    from tracefold.operators import depgraph as G
    parts = [f"regexp_extract_all({text}, '{_q(G.CAMEL_RE)}', 1)",
             f"list_filter(regexp_extract_all({text}, '{_q(G.SNAKE_RE)}', 1), lambda s: length(s) > 4)",
             f"regexp_extract_all({text}, '{_q(G.BRACKET_RE)}', 1)"]
    parts += [f"regexp_extract_all({text}, '([\\w]+{s})', 1)" for s in G.COMPONENT_SUFFIXES]
    parts.append(f"regexp_extract_all({text}, '{_q(G.CONTAINER_RE)}', 1)")
    return "list_distinct(" + " || ".join(parts) + ")"


def infra_depth_sql(name: str) -> str:
    from tracefold.operators import depgraph as G
    n = len(G.INFRA_DEPTH_ORDER)
    whens = " ".join(f"WHEN contains(lower({name}), '{kw}') THEN {n - i}"
                     for i, kw in enumerate(G.INFRA_DEPTH_ORDER))
    return f"(CASE {whens} ELSE 0 END)"


def graph_ctes(src: str = "patterns_b") -> str:
    """U1 + W7 over ``src`` patterns -> ``services``, ``nodes``, ``dep``."""
    return frame_lists_ctes(src) + f""",
mentions AS (SELECT bundle_id, pattern_key, unnest({mentions_sql('pattern')}) AS service FROM {src}),
services AS (SELECT DISTINCT bundle_id, service FROM (
  SELECT bundle_id, component AS service FROM frames
  UNION ALL SELECT bundle_id, service FROM mentions
  UNION ALL SELECT bundle_id, unnest(caused) AS service FROM frame_lists)),
chain_depth AS (SELECT bundle_id, component AS service, max(pos + 1) AS chain_depth FROM frames
  GROUP BY bundle_id, component),
nodes0 AS (SELECT s.bundle_id, s.service AS node,
  CAST(greatest({infra_depth_sql('s.service')}, coalesce(d.chain_depth, 0)) AS BIGINT) AS depth_score
  FROM services s LEFT JOIN chain_depth d ON s.bundle_id = d.bundle_id AND s.service = d.service),
nodes AS (SELECT bundle_id, node, depth_score,
  CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY depth_score DESC, node) - 1 AS BIGINT) AS position,
  CAST(count(*) OVER (PARTITION BY bundle_id) AS BIGINT) AS n_nodes FROM nodes0),
prio AS (SELECT bundle_id, lower(node) AS node_lc, max(n_nodes - 1 - position) AS priority FROM nodes
  GROUP BY bundle_id, lower(node)),
dep AS (SELECT p.bundle_id, p.pattern_key, CAST(max(r.priority) AS BIGINT) AS dependency_score
  FROM {src} p JOIN prio r ON p.bundle_id = r.bundle_id AND contains(lower(p.pattern), r.node_lc)
  GROUP BY p.bundle_id, p.pattern_key)"""


# --- bundle level ----------------------------------------------------------------

def service_case_sql(user_id: str = "user_id") -> str:
    return (f"CASE CAST({user_id} % 5 AS INT) WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service' "
            f"WHEN 2 THEN 'order-service' WHEN 3 THEN 'api-gateway' ELSE 'frontend-web' END")


def bundle_ctes() -> str:
    """Windows, attached events and metrics on top of patterns_b + graph."""
    from tracefold.plans.fixture import incident_events_cte
    return f""",
{incident_events_cte()},
win AS (SELECT bundle_id, split_part(bundle_id, '/', 1) AS source_id, min(first_ts) AS window_start,
  max(last_ts) AS window_end FROM patterns_b GROUP BY bundle_id),
ev_b AS (SELECT w.bundle_id, e.* FROM incident_events e JOIN win w ON e.service = w.source_id
  AND e.ts >= w.window_start AND e.ts <= w.window_end),
daily AS (SELECT {service_case_sql()} AS service, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'view' THEN 'cpu'
    WHEN 'click' THEN 'mem' WHEN 'error' THEN 'error_rate' ELSE 'latency' END AS metric, avg(value) AS x FROM events GROUP BY ALL),
zs AS (SELECT *, CASE WHEN stddev_samp(x) OVER (PARTITION BY service, metric) <> 0 THEN
  (x - avg(x) OVER (PARTITION BY service, metric)) / stddev_samp(x) OVER (PARTITION BY service, metric)
  END AS z FROM daily),
metrics AS (SELECT service || '/' || day AS bundle_id, service, day,
  max(z) FILTER (WHERE metric = 'cpu') AS cpu_z, max(z) FILTER (WHERE metric = 'mem') AS mem_z,
  max(z) FILTER (WHERE metric = 'latency') AS latency_z, max(z) FILTER (WHERE metric = 'error_rate')
  AS error_rate_z FROM zs GROUP BY ALL),
anomalies AS (SELECT bundle_id, ord, metric, label, z, printf('%s Z-score: %.2f', label, z) AS text FROM (
  SELECT bundle_id, 0 AS ord, 'cpu_z' AS metric, 'CPU' AS label, cpu_z AS z FROM metrics
  UNION ALL SELECT bundle_id, 1, 'mem_z', 'Memory', mem_z FROM metrics
  UNION ALL SELECT bundle_id, 2, 'latency_z', 'Latency', latency_z FROM metrics
  UNION ALL SELECT bundle_id, 3, 'error_rate_z', 'Error rate', error_rate_z FROM metrics)
  WHERE z IS NOT NULL AND z <> 0 AND abs(z) > 2.0)"""

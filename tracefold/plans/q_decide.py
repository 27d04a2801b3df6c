"""Registered queries: remediation proposals, history, decisions, safety.

Proposals are derived from the incident bundles (one per bundle with an error
hint); the feedback log is derived from ``events`` (every event is a past
remediation outcome of its service, of the kind its type stands for); history for a bundle day is the
cumulative feedback of the earlier days (as-of).  The safety configuration is
a small rule list, as the reference reads it from a config file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators import decide as D
from tracefold.operators import patterns as A
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.registry import register
from tracefold.session import table

RULES = D.SafetyRules(allowed_commands=["echo"], blocked_patterns=[r"helm delete", r"kubectl delete ns"],
                      matrix_overrides=[{"environment": "DEV", "scope": "INFRA", "level": "REQUIRE_APPROVAL"}])
SUCCESS_VALUE = 1.0

_ACTION = "struct<type:string,command:string,arguments:array<string>,file_path:string,original_context:string," \
          "replacement_text:string,xml_selector:string,xml_value:string>"

# per service: list of (type, command, arguments, file_path, original_context, replacement_text, xml_selector, xml_value)
SERVICE_ACTIONS = {
    "auth-service": [("RUNTIME_OP", "kubectl rollout restart deployment/auth-service", None, None, None, None, None,
                      None)],
    "payment-service": [("COMMAND", "kubectl get pods -l app=payment-service", None, None, None, None, None, None),
                        ("COMMAND", "git add .", None, None, None, None, None, None)],
    "order-service": [("COMMAND", "ls", ["/var/log/order-service"], None, None, None, None, None),
                      ("COMMAND", "cat app.log | grep ERROR", None, None, None, None, None, None)],
    "api-gateway": [("COMMAND", "echo reload", ["api-gateway"], None, None, None, None, None),
                    ("FILE_EDIT", "Raise pool size", None, "src/main/resources/application.yml",
                     "maximum-pool-size: 10", "maximum-pool-size: 30", None, None)],
    "frontend-web": [("XML_EDIT", "Remove stale dependency", None, "pom.xml", None, None, "dependency", None),
                     ("COMMAND", "rm -rf /tmp/cache", None, None, None, None, None, None)],
}
CATEGORY = [("Database connection pool issues detected", "connection pool exhaustion"),
            ("HTTP 404 errors detected", "missing route"), ("Timeout errors detected", "timeouts"),
            ("Memory issues detected", "memory pressure")]
#: event type -> the kind of incident whose remediation the event reports on
FEEDBACK_CATEGORY = {"purchase": "connection pool exhaustion", "view": "missing route", "click": "timeouts",
                     "signup": "memory pressure", "error": "errors"}
DEV_SERVICES = ["api-gateway", "frontend-web"]


def _lit_action(a) -> F.Column:
    t, cmd, args, fp, oc, rt, xs, xv = a
    arr = F.array(*[F.lit(x) for x in args]) if args else F.lit(None).cast("array<string>")
    return F.struct(F.lit(t).alias("type"), F.lit(cmd).alias("command"), arr.alias("arguments"),
                    F.lit(fp).cast("string").alias("file_path"), F.lit(oc).cast("string").alias("original_context"),
                    F.lit(rt).cast("string").alias("replacement_text"), F.lit(xs).cast("string").alias("xml_selector"),
                    F.lit(xv).cast("string").alias("xml_value"))


def _sql_str(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _sql_action(a) -> str:
    t, cmd, args, fp, oc, rt, xs, xv = a
    arr = "NULL::VARCHAR[]" if not args else "[" + ", ".join(_sql_str(x) for x in args) + "]"
    return (f"{{'type': {_sql_str(t)}, 'command': {_sql_str(cmd)}, 'arguments': {arr}, 'file_path': "
            f"{_sql_str(fp)}::VARCHAR, 'original_context': {_sql_str(oc)}::VARCHAR, 'replacement_text': "
            f"{_sql_str(rt)}::VARCHAR, 'xml_selector': {_sql_str(xs)}::VARCHAR, 'xml_value': {_sql_str(xv)}::VARCHAR}}")


def proposals(spark, sf_dir) -> DataFrame:
    """One remediation proposal per bundle with an error hint (E4 input)."""
    pats = FL.patterns_b(spark, sf_dir)
    hint = A.derive_hint(pats, level="error_class", ord_col="first_entry_no")
    n = pats.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_patterns"))
    p = hint.join(n, "bundle_id").withColumn("service", F.substring_index("bundle_id", "/", 1)).withColumn(
        "day", F.substring_index("bundle_id", "/", -1))
    cat = F.lit("errors")
    for prefix, name in reversed(CATEGORY):
        cat = F.when(F.col("hint").startswith(prefix), F.lit(name)).otherwise(cat)
    acts = F.lit(None).cast(f"array<{_ACTION}>")
    for svc, lst in SERVICE_ACTIONS.items():
        acts = F.when(F.col("service") == svc, F.array(*[_lit_action(a) for a in lst])).otherwise(acts)
    return p.select(F.col("bundle_id").alias("proposal_id"), "service", "day",
                    F.concat(F.lit("Mitigate "), cat, F.lit(" on "), F.col("service")).alias("title"),
                    F.round(F.lit(0.60) + F.lit(0.04) * (F.col("n_patterns") % 11), 2).alias("ai_confidence"),
                    acts.alias("actions"),
                    F.when(F.col("service").isin(*DEV_SERVICES), F.lit("DEV")).otherwise(F.lit("PROD"))
                    .alias("environment"),
                    F.lit("ops-bot").alias("git_user"), F.lit("ops@company.com").alias("git_email"))


def feedback_by_day(spark, sf_dir) -> DataFrame:
    """Feedback log from all events, one past remediation each -> per (title, day) counts of that day."""
    ev = table(spark, sf_dir, "events")
    svc = FL.service_of()
    name = F.create_map(*[F.lit(x) for pair in FEEDBACK_CATEGORY.items() for x in pair])
    log = ev.select(F.concat(F.lit("Mitigate "), name[F.col("event_type")], F.lit(" on "), svc).alias("signature"),
                    F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("value") >= SUCCESS_VALUE).alias("success"))
    return log.groupBy("signature", "day").agg(F.count_if("success").alias("success"),
                                               F.count(F.lit(1)).alias("total"))


def history_as_of(spark, sf_dir) -> DataFrame:
    """A8 as of each day: cumulative counts of the strictly earlier days."""
    d = feedback_by_day(spark, sf_dir)
    w = Window.partitionBy("signature").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    prior = d.select("signature", "day", F.coalesce(F.sum("success").over(w), F.lit(0)).cast("long").alias("success"),
                     F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long").alias("total"))
    return D.success_rates(prior)


def scored(spark, sf_dir) -> DataFrame:
    p = proposals(spark, sf_dir)
    return D.score_proposals(D.attach_history(p, history_as_of(spark, sf_dir), as_of="day"))


# --- oracle SQL ------------------------------------------------------------------

def _cat_sql() -> str:
    whens = " ".join(f"WHEN starts_with(hint, '{p}') THEN '{n}'" for p, n in CATEGORY)
    return f"CASE {whens} ELSE 'errors' END"


def _acts_sql() -> str:
    whens = " ".join(f"WHEN service = '{svc}' THEN [{', '.join(_sql_action(a) for a in lst)}]"
                     for svc, lst in SERVICE_ACTIONS.items())
    return f"CASE {whens} END"


_HINT = """,
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
  ELSE 'Primary error: ' || substr(top_pattern, 1, 100) END AS hint FROM htop)"""

_PROPOSALS = "WITH " + O.patterns_b_ctes() + _HINT + f""",
np AS (SELECT bundle_id, count(*) AS n_patterns FROM patterns_b GROUP BY bundle_id),
p0 AS (SELECT h.bundle_id, hint, n_patterns, split_part(h.bundle_id, '/', 1) AS service,
  split_part(h.bundle_id, '/', 2) AS day FROM hint h JOIN np USING (bundle_id)),
proposals AS (SELECT bundle_id AS proposal_id, service, day, 'Mitigate ' || {_cat_sql()} || ' on ' || service AS title,
  CAST(round(0.60 + 0.04 * (n_patterns % 11), 2) AS DOUBLE) AS ai_confidence, {_acts_sql()} AS actions,
  CASE WHEN service IN ('api-gateway', 'frontend-web') THEN 'DEV' ELSE 'PROD' END AS environment,
  'ops-bot' AS git_user, 'ops@company.com' AS git_email FROM p0),
fb AS (SELECT 'Mitigate ' || CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEEDBACK_CATEGORY.items())} END
    || ' on ' || {O.service_case_sql()} AS signature,
  strftime(ts, '%Y-%m-%d') AS day, value >= {SUCCESS_VALUE} AS success FROM events),
fbd AS (SELECT signature, day, count_if(success) AS success, count(*) AS total FROM fb GROUP BY ALL),
hist AS (SELECT signature, day,
  CAST(coalesce(sum(success) OVER (PARTITION BY signature ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS success,
  CAST(coalesce(sum(total) OVER (PARTITION BY signature ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS total FROM fbd),
rates AS (SELECT *, CASE WHEN total >= 3 THEN success / total END AS success_rate FROM hist),
sc0 AS (SELECT p.*, r.success_rate AS history_score,
  CASE WHEN r.success_rate IS NOT NULL THEN ai_confidence * 0.4 + r.success_rate * 0.6 ELSE ai_confidence END
    AS final_score,
  coalesce(list_bool_or(list_transform(actions, lambda a: a.type = 'RUNTIME_OP')), false) AS has_runtime
  FROM proposals p LEFT JOIN rates r ON p.title = r.signature AND p.day = r.day),
scored AS (SELECT *, CAST(CASE WHEN has_runtime THEN 0.7 ELSE 0.8 END AS DOUBLE) AS threshold,
  CASE WHEN final_score < (CASE WHEN has_runtime THEN 0.7 ELSE 0.8 END) THEN 'REQUIRE_APPROVAL'
    WHEN final_score >= 0.99 AND history_score IS NULL THEN 'REQUIRE_APPROVAL'
    WHEN final_score >= 0.99 THEN 'SAFE' ELSE 'REQUIRE_APPROVAL' END AS decision,
  CASE WHEN final_score < (CASE WHEN has_runtime THEN 0.7 ELSE 0.8 END) THEN
      'Low confidence (< ' || CASE WHEN has_runtime THEN '0.7' ELSE '0.8' END || '). Forcing HITL.'
    WHEN final_score >= 0.99 AND history_score IS NULL THEN '{D.REASON_NO_HISTORY}'
    WHEN final_score >= 0.99 THEN '{D.REASON_VERIFIED}' ELSE '{D.REASON_MEDIUM}' END AS reason FROM sc0)"""


@register("A8_success_rates", _PROPOSALS + """
SELECT signature, day, success, total, success_rate FROM rates""")
def q_success_rates(spark, sf_dir):
    return history_as_of(spark, sf_dir).select("signature", "day", "success", "total", "success_rate")


@register("S6_load_feedback", _PROPOSALS + """
SELECT signature, day, success, total FROM fbd""")
def q_load_feedback(spark, sf_dir):
    """Feedback documents (one JSON map per day, as the reference stores them)
    written from the log and read back."""
    d = feedback_by_day(spark, sf_dir)
    docs = d.groupBy("day").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "signature", F.struct("success", "total"))))).alias("json"))
    return D.load_feedback(docs, keep=("day",)).select("signature", "day", "success", "total")


@register("J4_attach_history", _PROPOSALS + """
SELECT proposal_id, title, history_score FROM sc0""")
def q_attach_history(spark, sf_dir):
    return scored(spark, sf_dir).select("proposal_id", "title", "history_score")


@register("G1_score_proposals", _PROPOSALS + """
SELECT proposal_id, round(final_score, 6) AS final_score, threshold, decision, reason FROM scored""")
def q_score_proposals(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("proposal_id", F.round("final_score", 6).alias("final_score"), "threshold", "decision", "reason")


def _rules_sql(cmd: str, matrix: str | None) -> str:
    def rl(pats):
        return " OR ".join(f"regexp_matches({cmd}, '{p}')" for p in pats) or "false"
    # RE2 spelling of the system block list (same strings; RE2 accepts them as written)
    c = f"regexp_replace({cmd}, '^\\s+|\\s+$', '', 'g')"
    base = f"string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ')[1]"
    safe = ", ".join(f"'{x}'" for x in D.SAFE_COMMANDS)
    appr = ", ".join(f"'{x}'" for x in D.APPROVAL_COMMANDS)
    allow = ", ".join(f"'{x}'" for x in RULES.allowed_commands)
    sysb = " OR ".join(f"regexp_matches({c}, '{p}')" for p in D.BLOCKED_PATTERNS)
    userb = " OR ".join(f"regexp_matches({c}, '{p}')" for p in RULES.blocked_patterns)
    m = ""
    if matrix:
        m = f"WHEN {matrix} = 'BLOCKED' THEN 'BLOCKED' WHEN {matrix} = 'REQUIRE_APPROVAL' THEN 'REQUIRE_APPROVAL' "
    return (f"(CASE WHEN {c} IS NULL OR {c} = '' THEN 'REQUIRE_APPROVAL' WHEN {userb} THEN 'BLOCKED' "
            f"WHEN {sysb} THEN 'BLOCKED' {m}WHEN {base} IN ({allow}) THEN 'SAFE' "
            f"WHEN {base} IN ({safe}) AND (contains({c}, '>') OR contains({c}, '|')) THEN 'REQUIRE_APPROVAL' "
            f"WHEN {base} IN ({safe}) THEN 'SAFE' WHEN {base} IN ({appr}) THEN 'REQUIRE_APPROVAL' "
            f"ELSE 'REQUIRE_APPROVAL' END)")


_ACTIONS_SQL = _PROPOSALS + """,
acts0 AS (SELECT proposal_id, environment, unnest(actions) AS a, generate_subscripts(actions, 1) - 1 AS pos
  FROM proposals),
acts AS (SELECT proposal_id, CAST(pos AS BIGINT) AS pos, environment,
  CASE WHEN a.type IN ('FILE_EDIT', 'XML_EDIT') THEN 'SOURCE_CODE' WHEN a.type = 'RUNTIME_OP' THEN 'INFRA'
    WHEN contains(a.command, 'kubectl') THEN 'INFRA' ELSE 'CONFIG' END AS scope,
  CASE WHEN a.type IN ('FILE_EDIT', 'XML_EDIT') THEN 'AUTO_PR' ELSE 'DIRECT_APPLY' END AS execution_mode,
  CASE WHEN a.type = 'COMMAND' THEN a.command || ' ' || coalesce(array_to_string(a.arguments, ' '), '')
    WHEN a.type = 'FILE_EDIT' THEN 'EDIT_FILE ' || coalesce(a.file_path, 'None') || ': ' || a.command
    ELSE a.command END AS command, a
  FROM acts0)"""


_G2_CMD = ("CASE WHEN starts_with(regexp_replace(command, '^\\s+|\\s+$', '', 'g'), 'git ') THEN "
           "'git -c user.name=''ops-bot'' -c user.email=''ops@company.com'' ' || "
           "substr(regexp_replace(command, '^\\s+|\\s+$', '', 'g'), 5) ELSE command END")


@register("G2_audit_commands", _ACTIONS_SQL + f""",
chk AS (SELECT a.proposal_id, a.pos, a.a.type AS type, {_G2_CMD} AS cmd,
  a.a.type = 'FILE_EDIT' AND (a.a.file_path IS NULL OR a.a.original_context IS NULL OR a.a.replacement_text IS NULL)
  OR a.a.type = 'XML_EDIT' AND (a.a.file_path IS NULL OR a.a.xml_selector IS NULL OR a.a.xml_value IS NULL)
    AS malformed FROM acts a),
lv AS (SELECT *, CASE WHEN type IN ('COMMAND', 'PATCH', 'API_CALL') THEN {_rules_sql('cmd', None)} END AS level
  FROM chk),
g AS (SELECT s.proposal_id, s.decision, count(lv.pos) AS n_actions, count_if(coalesce(lv.level = 'BLOCKED', false))
    AS n_blocked, count_if(coalesce(lv.malformed, false)) AS n_malformed,
  coalesce(array_to_string(list(lv.cmd ORDER BY lv.pos) FILTER (WHERE lv.level = 'BLOCKED'), ' ;; '), '')
    AS blocked_commands
  FROM scored s LEFT JOIN lv ON s.proposal_id = lv.proposal_id GROUP BY s.proposal_id, s.decision)
SELECT proposal_id, decision, n_actions, n_blocked, n_malformed, blocked_commands, decision = 'SAFE' AS executed,
  CASE WHEN decision = 'SAFE' THEN n_blocked = 0 AND n_malformed = 0 END AS success FROM g""")
def q_audit_commands(spark, sf_dir):
    g = D.audit_commands(scored(spark, sf_dir), rules=RULES)
    return g.select("proposal_id", "decision", "n_actions", "n_blocked", "n_malformed",
                    F.array_join("blocked_commands", " ;; ").alias("blocked_commands"), "executed", "success")

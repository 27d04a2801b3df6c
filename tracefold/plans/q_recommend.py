"""Registered queries: model replies -> recommendations -> responses, run metrics.

The model replies are an offline-inference output table.  Its stand-in has one
reply per (user, day) of ``events``, built by one SQL text that Spark and DuckDB
run unchanged: bare, fenced, prose-wrapped and truncated replies, parts that are
left out, null or of another type, every kind of action, status and severity,
steered by the smallest event id of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators import patterns as A
from tracefold.operators import recommend as R
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.registry import register
from tracefold.session import table

REPLIES_SQL = """
WITH inc AS (SELECT concat('r', CAST(min(event_id) AS STRING)) AS reply_id, min(event_id) AS e, count(*) AS n, service, day,
    concat(service, '/', day) AS bundle_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_errors
  FROM (SELECT event_id, event_type, user_id, substr(CAST(ts AS STRING), 1, 10) AS day,
    CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service'
      WHEN 2 THEN 'order-service' WHEN 3 THEN 'api-gateway' ELSE 'frontend-web' END AS service FROM {events}) x
  GROUP BY user_id, service, day),
p AS (SELECT *, CASE WHEN e % 9 = 0 THEN '0.0' WHEN e % 9 < 4 THEN '0.95' WHEN e % 9 = 4 THEN '0.85' ELSE '0.55' END AS conf,
    CASE CAST(e % 6 AS INT) WHEN 0 THEN 'Critical' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'low' WHEN 3 THEN 'High' WHEN 4 THEN 'medium'
      ELSE 'weird' END AS risk FROM inc),
body AS (SELECT *, concat('{{', CASE WHEN e % 3 = 0 THEN concat('"incident_id": "inc_', CAST(e AS STRING), '", ') ELSE '' END,
  CASE WHEN e % 4 = 1 THEN '"processing_time_ms": 812.25, "analyzed_at": "2026-01-19T10:00:00Z", "analysis_id": "given", ' ELSE '' END,
  '"root_cause_analysis": {{"summary": "', CAST(n_errors AS STRING), ' errors in ', service, '", "primary_cause": "',
  CASE WHEN e % 7 = 0 THEN 'unknown' ELSE concat('connection pool exhausted in ', service) END, '"',
  CASE WHEN e % 23 = 0 THEN '' ELSE ', "impact": "requests failing"' END,
  CASE WHEN e % 5 = 2 THEN '' ELSE ', "contributing_factors": ["traffic", "slow queries"]' END,
  CASE CAST(e % 29 AS INT) WHEN 3 THEN ', "evidence": null' WHEN 4 THEN ', "evidence": ["a"]' WHEN 5 THEN ''
    ELSE concat(', "evidence": {{"errors": ', CAST(n_errors AS STRING), ', "logs": ["first", "second"], "pool": {{"active": 50, "name": "main"}}}}') END,
  ', "timeline": ["', day, ' first error", "pool saturated"]}}, "causal_chain": [',
  CASE WHEN e % 5 = 4 THEN '' ELSE concat('{{"step": 1, "event": "pool saturated", "timestamp": "', day, 'T10:00:00Z", "metric": "active", "value": 50, ',
    '"normal": 12.5, "anomaly_score": 3.25, "max": 50, "wait_time_ms": 900.5, "affected_requests": ', CAST(n AS STRING),
    '}}, {{"step": 2, "event": "', CAST(n_errors AS STRING), ' errors", "timestamp": "', day, 'T10:00:05Z"}}') END,
  '], "recommendations": [',
  CASE WHEN e % 8 = 6 THEN '' ELSE concat('{{"rank": ', CASE WHEN e % 31 = 5 THEN '"first"' ELSE '1' END,
    CASE WHEN e % 2 = 0 THEN concat(', "recommendation_id": "rec_', CAST(e AS STRING), '"') ELSE '' END,
    ', "title": "Scale ', service, '", "description": "Add replicas", "fix_type": "',
    CASE CAST(e % 3 AS INT) WHEN 0 THEN 'runtime_remediation' WHEN 1 THEN 'config_change' ELSE 'xml_block_edit' END,
    '", "estimated_effort": "', CASE WHEN e % 11 = 1 THEN '' ELSE 'Low' END, '", "estimated_time_minutes": 15, "risk_level": "', risk,
    '", "cost_impact": "none", ',
    CASE WHEN e % 8 = 5 THEN '' ELSE concat('"implementation": {{"type": "',
      CASE CAST(e % 5 AS INT) WHEN 0 THEN 'local_config' WHEN 1 THEN 'local_file_edit' ELSE 'local_command' END, '", "commands": [',
      CASE WHEN e % 4 = 2 THEN '' ELSE concat('"kubectl scale deployment/', service, ' --replicas=3", "kubectl get pods"') END,
      '], "file_edits": [',
      CASE CAST(e % 4 AS INT) WHEN 1 THEN '{{"file_path": "pom.xml", "original_context": "<dependency>", "replacement_text": "", "xml_selector": "dependency", "xml_value": "4.2"}}'
        WHEN 3 THEN '{{"file_path": "application.yml", "original_context": "pool: 10", "replacement_text": "pool: 30"}}' ELSE '' END,
      '], "pre_checks": ["kubectl version"], "post_checks": ["kubectl get pods"]}}, ') END,
    CASE CAST(e % 6 AS INT) WHEN 1 THEN '"current_state": {{"replicas": 1}}, "target_state": {{"replicas": 3}}, ' WHEN 2 THEN '"current_state": null, ' ELSE '' END,
    CASE WHEN e % 3 = 1 THEN '' ELSE concat('"rollback": {{"commands": ["kubectl rollout undo deployment/', service,
      '"], "automatic_rollback_if": ["errors > 5"], "rollback_time_seconds": 60}}, ') END,
    '"reasoning": "pool saturation", "side_effects": ["cost"], "ai_confidence": ', conf,
    ', "similar_cases": [{{"incident_id": "inc_', CAST(e % 50 AS STRING), '", "similarity": 0.91, ',
    '"fix_applied": "scale", "outcome": "resolved", "resolution_time_minutes": 12}}]}}',
    CASE WHEN e % 2 = 1 THEN '' ELSE concat(', {{"rank": 2, "title": "Review pool settings", "description": "Tune pool", "fix_type": "config_change", ',
      '"estimated_effort": "Medium", "estimated_time_minutes": 30, "risk_level": "medium", "cost_impact": "none", ',
      '"reasoning": "limits", "ai_confidence": 0.6, "similar_cases": [{{"incident_id": "inc_7", "similarity": 0.8, ',
      '"fix_applied": "tune", "outcome": "resolved", "resolution_time_minutes": 25}}, {{"incident_id": "inc_',
      CAST(e % 50 AS STRING), '", "similarity": 0.75, "fix_applied": "scale", "outcome": "resolved", "resolution_time_minutes": 12}}]}}') END) END,
  '], "confidence_assessment": {{"final_confidence": ', conf, ', "action": "',
  CASE WHEN e % 9 < 5 THEN 'auto_heal' ELSE 'manual_review' END, '", "threshold_used": 0.85, "risk_level": "',
  CASE WHEN e % 4 = 3 THEN '' ELSE risk END,
  '", "breakdown": {{"history": 0.25, "pattern": 0.5}}, "adjustments": {{"bonuses": ["seen before"], "penalties": []}}, "reasoning": "derived", ',
  '"decision_factors": ', CASE WHEN e % 37 = 1 THEN '"none"' ELSE '{{"reviewed": false}}' END, '}}, "requires_human_review": ',
  CASE WHEN e % 5 = 0 THEN 'true' ELSE 'false' END, ', "auto_heal_candidate": ', CASE WHEN e % 4 = 2 THEN 'true' ELSE 'false' END,
  CASE WHEN e % 2 = 0 THEN concat(', "metadata": {{"model_used": "llama3", "rag_incidents_used": ', CAST(e % 6 AS STRING), '}}') ELSE '' END,
  ', "plan": {{', CASE WHEN e % 6 = 5 THEN '' ELSE concat('"title": "Scale ', service, '", "risk_assessment": "', risk, '", ') END,
  '"reasoning": "pool saturation"}}, "actions": [{{"type": "',
  CASE CAST(e % 9 AS INT) WHEN 0 THEN 'SHELL' WHEN 1 THEN 'COMMAND' WHEN 2 THEN 'PATCH' WHEN 3 THEN 'API_CALL' WHEN 4 THEN 'FILE_EDIT'
    WHEN 5 THEN 'XML_EDIT' ELSE 'RUNTIME_OP' END, '", "command": "kubectl scale deployment/',
  service, '", "arguments": ["--replicas=', CAST(1 + e % 5 AS STRING), '"]}}', CASE WHEN e % 3 = 0 THEN ', {{"command": "ls", "context": "/srv"}}' ELSE '' END,
  '], "confidence_score": ', conf, '}}') AS doc FROM p)
SELECT reply_id, bundle_id, service, e, CASE CAST(e % 5 AS INT)
  WHEN 1 THEN concat('Here is my analysis:', chr(10), '```json', chr(10), doc, chr(10), '```', chr(10), 'Let me know.')
  WHEN 2 THEN concat('Analysis follows. ', doc, ' -- end of answer')
  WHEN 3 THEN CASE WHEN e % 2 = 0 THEN substr(doc, 1, 60) ELSE doc END ELSE doc END AS reply,
  CASE WHEN e % 10 = 8 THEN 'degraded' WHEN e % 2 = 0 THEN 'llama3' ELSE 'mixtral' END AS model_used,
  CAST(800 + 37 * (e % 23) AS DOUBLE) AS latency_ms
FROM body
"""


def replies(spark, sf_dir) -> DataFrame:
    """The rows that the replies are written from are few bytes, and adaptive execution joins
    them into few tasks; the replies are dealt out to all cores before they are parsed."""
    r = spark.sql(REPLIES_SQL, events=table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return r.repartition(n, "reply_id")


def recs(spark, sf_dir) -> DataFrame:
    return R.parse_model_output(replies(spark, sf_dir), key="reply_id", keep=("bundle_id",))


# --- DuckDB side ----------------------------------------------------------------

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

_REC_STRUCT = ('{"incident_id": "VARCHAR", "analysis_id": "VARCHAR", "analyzed_at": "VARCHAR", "processing_time_ms": "DOUBLE", '
               '"root_cause_analysis": {"summary": "VARCHAR", "primary_cause": "VARCHAR", "contributing_factors": ["VARCHAR"], '
               '"timeline": ["VARCHAR"], "impact": "VARCHAR"}, "causal_chain": [{"step": "BIGINT", "event": "VARCHAR", '
               '"timestamp": "VARCHAR", "metric": "VARCHAR", "value": "DOUBLE", "normal": "DOUBLE", "anomaly_score": "DOUBLE", '
               '"max": "DOUBLE", "wait_time_ms": "DOUBLE", "affected_requests": "BIGINT"}], '
               '"recommendations": [{"rank": "BIGINT", "recommendation_id": "VARCHAR", "title": "VARCHAR", "description": "VARCHAR", '
               '"fix_type": "VARCHAR", "estimated_effort": "VARCHAR", "estimated_time_minutes": "BIGINT", '
               '"risk_level": "VARCHAR", "cost_impact": "VARCHAR", "implementation": {"type": "VARCHAR", '
               '"commands": ["VARCHAR"], "file_edits": [{"file_path": "VARCHAR", "original_context": "VARCHAR", '
               '"replacement_text": "VARCHAR", "xml_selector": "VARCHAR", "xml_value": "VARCHAR"}], "pre_checks": ["VARCHAR"], '
               '"post_checks": ["VARCHAR"]}, "current_state": "JSON", "target_state": "JSON", '
               '"rollback": {"commands": ["VARCHAR"], "automatic_rollback_if": ["VARCHAR"], "rollback_time_seconds": "BIGINT"}, '
               '"reasoning": "VARCHAR", "side_effects": ["VARCHAR"], '
               '"ai_confidence": "DOUBLE", "similar_cases": [{"incident_id": "VARCHAR", "similarity": "DOUBLE", '
               '"fix_applied": "VARCHAR", "outcome": "VARCHAR", "resolution_time_minutes": "BIGINT"}]}], '
               '"confidence_assessment": {"final_confidence": "DOUBLE", "action": "VARCHAR", "threshold_used": "DOUBLE", '
               '"risk_level": "VARCHAR", "breakdown": {"history": "DOUBLE", "pattern": "DOUBLE"}, '
               '"adjustments": {"bonuses": ["VARCHAR"], "penalties": ["VARCHAR"]}, "reasoning": "VARCHAR"}, '
               '"requires_human_review": "BOOLEAN", "auto_heal_candidate": "BOOLEAN"}')

_PARSED = "WITH replies AS (" + REPLIES_SQL.strip().format(events="events") + f"""),
rj0 AS (SELECT *, {_STRIP.format(x='reply')} AS t FROM replies),
rj1 AS (SELECT *, CASE WHEN starts_with(t, '{{') AND json_valid(t) THEN t END AS whole,
  list_filter(list_transform(regexp_extract_all(t, '{R.FENCED_RE}', 1), lambda b: {_STRIP.format(x='b')}),
    lambda b: json_valid(b))[1] AS fenced,
  regexp_extract(t, '{R.BRACED_RE}') AS braced FROM rj0),
rj AS (SELECT *, coalesce(whole, fenced, CASE WHEN braced <> '' AND json_valid(braced) THEN braced END) AS j FROM rj1),
rt AS (SELECT *, json_transform(j, '{_REC_STRUCT}') AS r FROM rj),
rv AS (SELECT *, j IS NOT NULL AND r IS NOT NULL
  AND r.root_cause_analysis.summary IS NOT NULL AND r.root_cause_analysis.primary_cause IS NOT NULL
  AND r.root_cause_analysis.impact IS NOT NULL AND r.causal_chain IS NOT NULL
  AND coalesce(json_type(j, '$.root_cause_analysis.evidence'), 'OBJECT') = 'OBJECT'
  AND coalesce(json_type(j, '$.confidence_assessment.decision_factors'), 'NONE') = 'OBJECT'
  AND coalesce(list_bool_and(list_transform(r.recommendations, lambda x: x.rank IS NOT NULL)), true)
  AND r.confidence_assessment.final_confidence IS NOT NULL AS ok FROM rt),
recs AS (SELECT reply_id, bundle_id, service, model_used, latency_ms, j, reply, r, NOT coalesce(ok, false) AS degraded,
  CASE WHEN ok THEN r.root_cause_analysis.summary ELSE '{R.DEGRADED_SUMMARY}' END AS summary,
  CASE WHEN ok THEN r.root_cause_analysis.primary_cause ELSE 'unknown' END AS primary_cause,
  CASE WHEN ok THEN coalesce(r.root_cause_analysis.timeline, []) ELSE [] END AS timeline,
  CASE WHEN ok THEN r.causal_chain ELSE [] END AS chain,
  CASE WHEN ok THEN r.recommendations ELSE [] END AS recommendations,
  CASE WHEN ok THEN r.confidence_assessment.final_confidence ELSE 0.0 END AS final_confidence,
  CASE WHEN ok THEN r.confidence_assessment.action ELSE 'manual_review' END AS action,
  CASE WHEN ok THEN r.confidence_assessment.risk_level ELSE 'unknown' END AS risk_level,
  CASE WHEN ok THEN r.requires_human_review ELSE true END AS requires_human_review,
  CASE WHEN ok THEN r.auto_heal_candidate ELSE false END AS auto_heal_candidate FROM rv)"""


def _joined(c: str, sep: str = " ;; ") -> F.Column:
    return F.array_join(c, sep)


@register("P12_parse_model_output", _PARSED + f"""
SELECT reply_id, degraded, CASE WHEN NOT degraded THEN r.incident_id END AS incident_id,
  coalesce(CASE WHEN NOT degraded THEN r.analysis_id END, 'analysis_' || substr(md5(reply_id), 1, 12)) AS analysis_id,
  CASE WHEN NOT degraded THEN r.analyzed_at END AS analyzed_at,
  coalesce(CASE WHEN NOT degraded THEN r.processing_time_ms END, 0.0)::DOUBLE AS processing_time_ms, summary, primary_cause,
  CASE WHEN degraded THEN 'unknown' ELSE r.root_cause_analysis.impact END AS impact,
  CASE WHEN degraded THEN '' ELSE array_to_string(coalesce(r.root_cause_analysis.contributing_factors, []), ' ;; ') END AS contributing_factors,
  array_to_string(timeline, ' ;; ') AS timeline, final_confidence, action,
  CASE WHEN degraded THEN 0.0::DOUBLE ELSE r.confidence_assessment.threshold_used END AS threshold_used, risk_level,
  CASE WHEN degraded THEN '' ELSE 'history=' || r.confidence_assessment.breakdown.history || ' pattern=' || r.confidence_assessment.breakdown.pattern END
    AS breakdown,
  CASE WHEN degraded THEN 'bonuses= penalties=' ELSE 'bonuses=' || array_to_string(r.confidence_assessment.adjustments.bonuses, ',') || ' penalties='
    || array_to_string(r.confidence_assessment.adjustments.penalties, ',') END AS adjustments,
  CASE WHEN degraded THEN '{R.DEGRADED_REASONING}' ELSE r.confidence_assessment.reasoning END AS confidence_reasoning,
  requires_human_review, auto_heal_candidate, md5(substr(reply, 1, 5000)) AS raw_digest FROM recs""")
def q_parse_model_output(spark, sf_dir):
    r = recs(spark, sf_dir)
    entries = F.array_sort(F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    lists = F.array_sort(F.transform(F.map_entries("adjustments"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))))
    return r.select("reply_id", "degraded", "incident_id", "analysis_id", "analyzed_at", "processing_time_ms", "summary",
                    "primary_cause", "impact", _joined("contributing_factors").alias("contributing_factors"),
                    _joined("timeline").alias("timeline"), "final_confidence", "action", "threshold_used", "risk_level",
                    F.array_join(entries, " ").alias("breakdown"), F.array_join(lists, " ").alias("adjustments"),
                    "confidence_reasoning", "requires_human_review", "auto_heal_candidate",
                    F.md5("raw_model_output").alias("raw_digest"))


@register("P12_causal_chain", _PARSED + """
SELECT reply_id, s.* FROM (SELECT reply_id, unnest(chain) AS s FROM recs)""")
def q_causal_chain(spark, sf_dir):
    return recs(spark, sf_dir).select("reply_id", F.explode("causal_chain").alias("s")).select("reply_id", "s.*")


@register("P12_recommendations", _PARSED + """,
x AS (SELECT reply_id, unnest(recommendations) AS x, generate_subscripts(recommendations, 1) - 1 AS i FROM recs)
SELECT reply_id, x.rank AS rank, coalesce(x.recommendation_id, 'rec_' || substr(md5(md5(reply_id) || '#' || i), 1, 8)) AS recommendation_id,
  x.title AS title, x.description AS description, x.fix_type AS fix_type, x.estimated_effort AS estimated_effort,
  x.estimated_time_minutes AS estimated_time_minutes, x.risk_level AS risk_level, x.cost_impact AS cost_impact,
  x.implementation.type AS implementation_type, array_to_string(x.implementation.commands, ' ;; ') AS commands,
  array_to_string(list_transform(x.implementation.file_edits, lambda f: concat_ws('|', f.file_path, f.original_context, f.replacement_text,
    f.xml_selector, f.xml_value)), ' ;; ') AS file_edits,
  array_to_string(x.implementation.pre_checks, ' ;; ') AS pre_checks, array_to_string(x.implementation.post_checks, ' ;; ') AS post_checks,
  array_to_string(x.rollback.commands, ' ;; ') AS rollback_commands, array_to_string(x.rollback.automatic_rollback_if, ' ;; ') AS rollback_if,
  x.rollback.rollback_time_seconds AS rollback_time_seconds, x.reasoning AS reasoning, array_to_string(x.side_effects, ' ;; ') AS side_effects,
  x.ai_confidence AS ai_confidence, array_to_string(list_transform(x.similar_cases, lambda c: concat_ws('|', c.incident_id,
    c.similarity::VARCHAR, c.fix_applied, c.outcome, c.resolution_time_minutes::VARCHAR)), ' ;; ') AS similar_cases FROM x""")
def q_recommendations(spark, sf_dir):
    x = recs(spark, sf_dir).select("reply_id", F.explode("recommendations").alias("x"))
    impl, back = F.col("x.implementation"), F.col("x.rollback")
    plain = "rank recommendation_id title description fix_type estimated_effort estimated_time_minutes risk_level cost_impact".split()
    edits = F.transform(impl["file_edits"], lambda f: F.concat_ws("|", *[f[n] for n in R.FILE_EDIT.names]))
    cases = F.transform(F.col("x.similar_cases"), lambda c: F.concat_ws("|", *[c[n].cast("string") for n in R.SIMILAR_CASE.names]))
    return x.select("reply_id", *[f"x.{c}" for c in plain], impl["type"].alias("implementation_type"),
                    _joined(impl["commands"]).alias("commands"), _joined(edits).alias("file_edits"),
                    _joined(impl["pre_checks"]).alias("pre_checks"), _joined(impl["post_checks"]).alias("post_checks"),
                    _joined(back["commands"]).alias("rollback_commands"), _joined(back["automatic_rollback_if"]).alias("rollback_if"),
                    back["rollback_time_seconds"].alias("rollback_time_seconds"), "x.reasoning",
                    _joined("x.side_effects").alias("side_effects"), "x.ai_confidence", _joined(cases).alias("similar_cases"))


@register("P12_free_members", _PARSED + """,
o AS (
  SELECT reply_id, 'evidence' AS part, NULL::BIGINT AS rec, json_extract(j, '$.root_cause_analysis.evidence') AS v FROM recs WHERE NOT degraded
  UNION ALL SELECT reply_id, 'decision_factors', NULL, json_extract(j, '$.confidence_assessment.decision_factors') FROM recs WHERE NOT degraded
  UNION ALL SELECT reply_id, 'metadata', NULL, CASE WHEN degraded THEN '{"error":"All models failed"}'::JSON ELSE json_extract(j, '$.metadata') END FROM recs
  UNION ALL SELECT reply_id, 'current_state', i, x.current_state FROM (SELECT reply_id, unnest(recommendations) AS x,
    generate_subscripts(recommendations, 1) - 1 AS i FROM recs)
  UNION ALL SELECT reply_id, 'target_state', i, x.target_state FROM (SELECT reply_id, unnest(recommendations) AS x,
    generate_subscripts(recommendations, 1) - 1 AS i FROM recs)),
k AS (SELECT *, unnest(json_keys(v)) AS name FROM o WHERE json_type(v) = 'OBJECT')
SELECT reply_id, part, rec, name, CAST(json_extract(v, '$.' || name) AS VARCHAR) AS value FROM k""")
def q_free_members(spark, sf_dir):
    return R.free_members(recs(spark, sf_dir), key="reply_id")


@register("P13_parse_proposals", _PARSED + """,
pp AS (SELECT reply_id, j, json_transform(j, '{"plan": {"title": "VARCHAR", "reasoning": "VARCHAR",
  "validation_strategy": "VARCHAR", "risk_assessment": "VARCHAR"}, "actions": [{"type": "VARCHAR",
  "command": "VARCHAR", "arguments": ["VARCHAR"], "context": "VARCHAR"}], "confidence_score": "DOUBLE"}') AS p FROM rt),
pv AS (SELECT *, j IS NOT NULL AND p IS NOT NULL AND coalesce(list_bool_and(list_transform(coalesce(p.actions, []),
  lambda a: coalesce(a.type, 'COMMAND') IN ('COMMAND', 'PATCH', 'API_CALL', 'FILE_EDIT', 'XML_EDIT', 'RUNTIME_OP'))),
  true) AS accepted FROM pp)
SELECT reply_id, accepted, CASE WHEN accepted THEN coalesce(p.plan.title, 'Unknown Plan') END AS title,
  CASE WHEN accepted THEN coalesce(p.plan.reasoning, 'No reasoning provided') END AS reasoning,
  CASE WHEN accepted THEN coalesce(p.plan.validation_strategy, 'Manual verification') END AS validation_strategy,
  CASE WHEN accepted THEN coalesce(p.plan.risk_assessment, 'High') END AS risk_assessment,
  CASE WHEN accepted THEN array_to_string(list_transform(coalesce(p.actions, []), lambda a: concat_ws('|', coalesce(a.type, 'COMMAND'),
    coalesce(a.command, ''), array_to_string(coalesce(a.arguments, []), ','), coalesce(a.context, '.'))), ' ;; ') END AS actions,
  CASE WHEN accepted THEN coalesce(p.confidence_score, 0.0) END AS confidence_score FROM pv""")
def q_parse_proposals(spark, sf_dir):
    p = R.parse_proposals(replies(spark, sf_dir), key="reply_id")
    acts = F.transform("actions", lambda a: F.concat_ws("|", a["type"], a["command"], F.array_join(a["arguments"], ","), a["context"]))
    return p.select("reply_id", "accepted", "title", "reasoning", "validation_strategy", "risk_assessment",
                    _joined(acts).alias("actions"), "confidence_score")


@register("P14_recommendation_to_actions", _PARSED + """,
top AS (SELECT reply_id, recommendations[1] AS t FROM recs WHERE len(recommendations) > 0),
cmds AS (SELECT reply_id, unnest(t.implementation.commands) AS command, generate_subscripts(t.implementation.commands, 1)
  AS i, CASE WHEN t.implementation.type IN ('local_file_edit', 'local_config') THEN 'FILE_EDIT'
    WHEN t.fix_type = 'runtime_remediation' THEN 'RUNTIME_OP' ELSE 'COMMAND' END AS type FROM top
  WHERE t.implementation IS NOT NULL),
nc AS (SELECT reply_id, coalesce(len(t.implementation.commands), 0) AS n FROM top),
eds AS (SELECT reply_id, unnest(t.implementation.file_edits) AS e, generate_subscripts(t.implementation.file_edits, 1)
  AS i, t.fix_type AS fix_type FROM top WHERE t.implementation IS NOT NULL)
SELECT reply_id, CAST(i - 1 AS BIGINT) AS pos, type, command, NULL AS file_path, NULL AS original_context, NULL AS replacement_text,
  NULL AS xml_selector, NULL AS xml_value FROM cmds
UNION ALL
SELECT eds.reply_id, CAST(n + i - 1 AS BIGINT), CASE WHEN fix_type = 'xml_block_edit' OR coalesce(e.xml_selector, '') <> ''
  THEN 'XML_EDIT' ELSE 'FILE_EDIT' END, 'Edit ' || e.file_path, e.file_path, e.original_context, e.replacement_text, e.xml_selector,
  e.xml_value FROM eds JOIN nc USING (reply_id)""")
def q_recommendation_to_actions(spark, sf_dir):
    return R.recommendation_to_actions(recs(spark, sf_dir), key="reply_id")


@register("P15_validate_recommendations", _PARSED + """
SELECT reply_id, array_to_string(list_filter([
  CASE WHEN primary_cause IS NULL OR primary_cause = '' OR primary_cause = 'unknown'
    THEN 'Root cause is unknown or missing' END,
  CASE WHEN coalesce(len(recommendations), 0) = 0 THEN 'No recommendations provided' END,
  CASE WHEN final_confidence = 0.0 THEN 'Confidence is zero' END,
  CASE WHEN auto_heal_candidate AND final_confidence < 0.7 THEN 'Auto-heal candidate with low confidence' END],
  lambda x: x IS NOT NULL), '; ') AS issues FROM recs""")
def q_validate_recommendations(spark, sf_dir):
    v = R.validate_recommendations(recs(spark, sf_dir), key="reply_id")
    return v.select("reply_id", F.array_join("issues", "; ").alias("issues"))


@register("A11_similar_case_ids", _PARSED + """
SELECT reply_id, array_to_string(list_distinct_ordered, ',') AS similar_cases FROM (
  SELECT reply_id, list_filter(flat, lambda x, i: list_position(flat, x) = i) AS list_distinct_ordered FROM (
    SELECT reply_id, flatten(list_transform(recommendations, lambda q: list_transform(coalesce(q.similar_cases, []),
      lambda s: s.incident_id))) AS flat FROM recs))""")
def q_similar_case_ids(spark, sf_dir):
    s = R.similar_case_ids(recs(spark, sf_dir), key="reply_id")
    return s.select("reply_id", F.array_join("similar_cases", ",").alias("similar_cases"))


def bundles(spark, sf_dir) -> DataFrame:
    """The bundles' affected services (A5) and the files that their day's commits changed."""
    ev = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, "Main.java").when(F.col("event_id") % 3 == 1, "HikariPool.java").otherwise("pom.xml")
    files = ev.where("value > 50").select(
        F.concat(FL.service_of(), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("bundle_id"), name.alias("file")).groupBy(
        "bundle_id").agg(F.sort_array(F.collect_set("file")).alias("changed_files"))
    return A.affected_services(FL.patterns_b(spark, sf_dir)).join(files, "bundle_id", "full")


@register("P16_to_incident_response", "WITH " + O.patterns_b_ctes() + f""",
affected AS (SELECT bundle_id, list_sort(list(DISTINCT svc)) AS affected_services FROM (
  SELECT bundle_id, {O.clean_service_sql('container')} AS svc FROM patterns_b
  WHERE error_class IN ('ERROR', 'WARNING') AND container IS NOT NULL AND container <> '') WHERE svc <> '' GROUP BY bundle_id),
changed AS (SELECT {O.service_case_sql()} || '/' || strftime(ts, '%Y-%m-%d') AS bundle_id, list_sort(list(DISTINCT CASE event_id % 3
  WHEN 0 THEN 'Main.java' WHEN 1 THEN 'HikariPool.java' ELSE 'pom.xml' END)) AS changed_files FROM events WHERE value > 50 GROUP BY ALL),
""" + _PARSED[len("WITH "):] + """,
fx AS (SELECT *, list_transform(recommendations, lambda q: {'risk': CASE WHEN coalesce(q.risk_level, '') <> ''
    THEN lower(q.risk_level) ELSE 'unknown' END, 'exe': coalesce(len(q.implementation.file_edits), 0) > 0
    OR coalesce(len(q.implementation.commands), 0) > 0,
    'text': concat_ws('|', 'fix_' || lpad(q.rank::VARCHAR, 3, '0'), q.rank, q.title, q.description,
      CASE WHEN coalesce(q.risk_level, '') <> '' THEN lower(q.risk_level) ELSE 'unknown' END,
      CASE WHEN coalesce(q.estimated_effort, '') <> '' THEN lower(q.estimated_effort) ELSE 'unknown' END,
      coalesce(array_to_string(list_transform(q.implementation.file_edits, lambda f: f.file_path || ':' || f.original_context || '>'
        || f.replacement_text), ','), ''), coalesce(array_to_string(q.implementation.commands, ','), ''),
      coalesce(array_to_string(q.implementation.post_checks, ','), ''), coalesce(q.rollback.commands[1], 'none'))}) AS fixes FROM recs),
sv AS (SELECT *, CASE WHEN coalesce(risk_level, '') <> '' THEN lower(risk_level)
    WHEN len(fixes) > 0 THEN lower(coalesce(recommendations[1].risk_level, 'unknown')) ELSE 'unknown' END AS raw,
  flatten(list_transform(recommendations, lambda q: list_transform(coalesce(q.similar_cases, []), lambda s: s.incident_id))) AS ids FROM fx)
SELECT reply_id, bundle_id, CASE WHEN NOT degraded THEN r.analyzed_at END AS analyzed_at,
  CASE WHEN NOT degraded AND r.processing_time_ms <> 0 THEN round(r.processing_time_ms, 1) END AS processing_time_ms,
  CASE WHEN final_confidence = 0.0 THEN 'analysis_failed' WHEN len(fixes) = 0 THEN 'manual_review'
    WHEN NOT coalesce(list_bool_or(list_transform(fixes, lambda f: f.exe)), false) THEN 'guidance_only'
    WHEN requires_human_review OR final_confidence < 0.85 THEN 'pending_approval' ELSE 'fix_available' END AS status,
  requires_human_review OR final_confidence < 0.85
    OR coalesce(list_bool_or(list_transform(fixes, lambda f: f.risk IN ('high', 'critical', 'unknown'))), false)
    AS approval_required, summary, primary_cause AS root_cause,
  CASE raw WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium'
    WHEN 'moderate' THEN 'medium' WHEN 'low' THEN 'low' WHEN 'unknown' THEN 'high' ELSE 'high' END AS severity,
  round(final_confidence, 3) AS confidence, array_to_string(timeline, ' ;; ') AS causal_chain,
  array_to_string(list_transform(fixes, lambda f: f.text), ' ;; ') AS fixes, false AS auto_applied,
  CASE WHEN degraded THEN 0 ELSE coalesce(CAST(json_extract(j, '$.metadata.rag_incidents_used') AS BIGINT), 0) END AS rag_incidents_used,
  array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS similar_cases,
  coalesce(array_to_string(affected_services, ','), '') AS affected_services, coalesce(array_to_string(changed_files, ','), '') AS affected_files
FROM sv LEFT JOIN affected USING (bundle_id) LEFT JOIN changed USING (bundle_id)""")
def q_to_incident_response(spark, sf_dir):
    r = R.to_incident_response(recs(spark, sf_dir), bundles(spark, sf_dir), key="reply_id", bundle="bundle_id")
    edits = lambda f: F.array_join(F.transform(f["file_edits"], lambda e: F.concat(
        e["file"], F.lit(":"), e["find"], F.lit(">"), e["replace"])), ",")
    text = F.transform("fixes", lambda f: F.concat_ws(
        "|", f["fix_id"], f["rank"].cast("string"), f["title"], f["description"], f["risk"], f["effort"], edits(f),
        F.array_join(f["commands"], ","), F.array_join(f["verify"], ","), F.coalesce(f["rollback"], F.lit("none"))))
    return r.select("reply_id", "bundle_id", "analyzed_at", "processing_time_ms", "status", "approval_required", "summary",
                    "root_cause", "severity", "confidence", _joined("causal_chain").alias("causal_chain"),
                    _joined(text).alias("fixes"), "auto_applied", "rag_incidents_used",
                    F.array_join("similar_cases", ",").alias("similar_cases"),
                    F.array_join("affected_services", ",").alias("affected_services"),
                    F.array_join("affected_files", ",").alias("affected_files"))


_METRICS = """count(*) AS total_requests, count_if(model_used <> 'degraded') AS successful,
  count_if(model_used = 'degraded') AS degraded, round(avg(latency_ms), 6) AS avg_latency_ms,
  count_if(model_used <> 'degraded') / greatest(count(*), 1) AS success_rate FROM recs"""


@register("A9_run_metrics", _PARSED + f"""
SELECT 'all' AS scope, {_METRICS} UNION ALL SELECT service, {_METRICS} GROUP BY service""")
def q_run_metrics(spark, sf_dir):
    """In total and per service."""
    calls = replies(spark, sf_dir)
    both = R.run_metrics(calls).withColumn("scope", F.lit("all")).unionByName(
        R.run_metrics(calls, group=("service",)).withColumnRenamed("service", "scope"))
    return both.select("scope", "total_requests", "successful", "degraded",
                       F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "success_rate")


@register("W11_running_latency", f"""
WITH c AS (SELECT event_id, {O.service_case_sql()} AS service, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT event_id, service,
  CAST(sum(cents) OVER w AS BIGINT) / count(*) OVER w / 100.0 AS running_avg_latency_ms
FROM c WINDOW w AS (PARTITION BY service ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_latency(spark, sf_dir):
    """Latency = the event value, summed exactly in hundredths of a millisecond."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", FL.service_of().alias("service"), F.round(F.col("value") * 100).cast("long").alias("latency_ms"))
    r = R.running_latency(ev, keys=("service",), order="event_id", exact=True)
    return r.select("event_id", "service", (F.col("running_avg_latency_ms") / 100.0).alias("running_avg_latency_ms"))

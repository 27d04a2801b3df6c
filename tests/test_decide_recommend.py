"""G1, J5, J6, G2, A8, S6 and reply parsing (P12-P16) on literal frames."""

import json

from pyspark.sql import functions as F

from tracefold.operators import decide as D
from tracefold.operators import recommend as R

ACT = "array<struct<type:string,command:string,arguments:array<string>,file_path:string,original_context:string," \
      "replacement_text:string,xml_selector:string,xml_value:string>>"


def proposals(spark, rows):
    return spark.createDataFrame(rows, f"proposal_id string, title string, ai_confidence double, "
                                       f"history_score double, actions {ACT}")


def cmd(t, c):
    return (t, c, None, None, None, None, None, None)


def test_confidence_thresholds(spark):
    rows = [("a", "t", 0.75, None, [cmd("COMMAND", "ls")]),
            ("b", "t", 0.75, None, [cmd("RUNTIME_OP", "kubectl rollout restart x")]),
            ("c", "t", 0.98, None, [cmd("COMMAND", "ls")]),
            ("d", "t", 0.99, None, [cmd("COMMAND", "ls")]),
            ("e", "t", 0.99, 1.0, [cmd("COMMAND", "ls")])]
    got = {r.proposal_id: (r.decision, r.reason) for r in D.score_proposals(proposals(spark, rows)).collect()}
    assert got["a"] == ("REQUIRE_APPROVAL", "Low confidence (< 0.8). Forcing HITL.")
    assert got["b"][1] == D.REASON_MEDIUM                                       # runtime op: threshold 0.7
    assert got["c"][1] == D.REASON_MEDIUM                                       # 0.98 is NOT high
    assert got["d"] == ("REQUIRE_APPROVAL", D.REASON_NO_HISTORY)
    assert got["e"] == ("SAFE", D.REASON_VERIFIED)


def test_safety_matrix_and_overrides(spark):
    df = spark.createDataFrame([("PROD", "SOURCE_CODE", "DIRECT_APPLY"), ("PROD", "SOURCE_CODE", "AUTO_PR"),
                                ("DEV", "INFRA", "DIRECT_APPLY"), ("PROD", "INFRA", "DIRECT_APPLY"),
                                ("DEV", "CONFIG", "DIRECT_APPLY")], "e string, s string, m string")
    plain = [r.l for r in df.select(D.safety_matrix(F.col("e"), F.col("s"), F.col("m"), D.SafetyRules()).alias("l"))
             .collect()]
    assert plain == ["BLOCKED", "REQUIRE_APPROVAL", "SAFE", "REQUIRE_APPROVAL", "REQUIRE_APPROVAL"]
    rules = D.SafetyRules(matrix_overrides=[{"environment": "DEV", "scope": "INFRA", "level": "REQUIRE_APPROVAL"}])
    assert df.select(D.safety_matrix(F.col("e"), F.col("s"), F.col("m"), rules).alias("l")).collect()[2].l == \
        "REQUIRE_APPROVAL"


def test_classify_commands(spark, tmp_path):
    cfg = tmp_path / "rules.json"
    cfg.write_text(json.dumps({"allowed_commands": ["kubectl"], "blocked_patterns": ["helm delete"]}))
    rules = D.load_safety_rules(str(cfg))
    assert D.load_safety_rules(str(tmp_path / "missing.json")) == D.SafetyRules()
    cases = {"git add .": "BLOCKED",                    # 'dd ' is a bare substring
             "ls -la": "SAFE", "cat a | grep b": "REQUIRE_APPROVAL", "rm -rf /": "BLOCKED",
             "kubectl get pods": "SAFE",                # user allow list on the base word
             "helm delete x": "BLOCKED", ":(){ :|:& };:": "BLOCKED", "echo hi > /etc/passwd": "BLOCKED",
             "terraform apply": "REQUIRE_APPROVAL", "   ": "REQUIRE_APPROVAL"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.l for r in df.select("c", D.classify_command(F.col("c"), rules).alias("l")).collect()}
    assert got == cases
    plain = {r.c: r.l for r in df.select("c", D.classify_command(F.col("c"), D.SafetyRules()).alias("l")).collect()}
    assert plain["kubectl get pods"] == "REQUIRE_APPROVAL"   # multi-word safe entries never match


def test_audit(spark):
    rows = [("p", "t", 0.99, 1.0, [cmd("COMMAND", "git add ."), cmd("RUNTIME_OP", "rm -rf /"),
                                   ("FILE_EDIT", "fix", None, None, None, None, None, None)])]
    s = D.score_proposals(proposals(spark, rows)).withColumn("git_user", F.lit("ops-bot")) \
        .withColumn("git_email", F.lit("ops@company.com"))
    a = D.audit_commands(s).first()
    assert a.decision == "SAFE" and a.executed and a.n_blocked == 1 and a.n_malformed == 1 and a.success is False
    assert a.blocked_commands == ["git -c user.name='ops-bot' -c user.email='ops@company.com' add ."]


def test_feedback_and_rates(spark):
    docs = spark.createDataFrame([(json.dumps({"a": {"success": 1, "total": 1}, "b": {"success": 2, "total": 2},
                                                "c": {"success": 5, "total": 6}, "d": {"success": 0, "total": 6}}),)],
                                 "json string")
    rates = {r.signature: r.success_rate for r in D.success_rates(D.load_feedback(docs)).collect()}
    assert rates["a"] is None and rates["b"] is None and abs(rates["c"] - 5 / 6) < 1e-12 and rates["d"] == 0.0


REC = {"root_cause_analysis": {"summary": "s", "primary_cause": "pool", "impact": "x"}, "causal_chain": [],
       "recommendations": [{"rank": 1, "title": "t", "description": "d", "fix_type": "runtime_remediation",
                            "estimated_effort": "Low", "estimated_time_minutes": 5, "risk_level": "Moderate",
                            "cost_impact": "none", "reasoning": "r", "ai_confidence": 0.9,
                            "implementation": {"type": "local_command", "commands": ["kubectl scale x"]},
                            "similar_cases": [{"incident_id": "i1", "similarity": 0.9, "fix_applied": "f",
                                               "outcome": "o", "resolution_time_minutes": 3}]}],
       "confidence_assessment": {"final_confidence": 0.9, "action": "auto_heal", "threshold_used": 0.85,
                                 "risk_level": "", "breakdown": {}, "adjustments": {}, "reasoning": "r",
                                 "decision_factors": {}},
       "requires_human_review": False, "auto_heal_candidate": True}


def test_parse_replies_and_response(spark):
    good = json.dumps(REC)
    missing = dict(REC, root_cause_analysis={"summary": "s", "primary_cause": "p"})     # impact missing
    replies = [("bare", good), ("fenced", f"Sure!\n```json\n{good}\n```\nbye"), ("prose", f"Answer: {good} end"),
               ("broken", good[:50]), ("missing", json.dumps(missing)), ("none", "no json at all")]
    df = spark.createDataFrame(replies, "bundle_id string, reply string")
    recs = R.parse_model_output(df)
    deg = {r.bundle_id: r.degraded for r in recs.collect()}
    assert deg == {"bare": False, "fenced": False, "prose": False, "broken": True, "missing": True, "none": True}
    resp = {r.bundle_id: r for r in R.to_incident_response(recs).collect()}
    assert resp["bare"].status == "fix_available" and resp["bare"].severity == "medium"
    assert resp["bare"].approval_required is False and resp["bare"].similar_cases == ["i1"]
    assert resp["broken"].status == "analysis_failed" and resp["broken"].severity == "high"
    acts = R.recommendation_to_actions(recs).where(F.col("bundle_id") == "bare").collect()
    assert [(a.type, a.command) for a in acts] == [("RUNTIME_OP", "kubectl scale x")]
    issues = {r.bundle_id: r.issues for r in R.validate_recommendations(recs).collect()}
    assert issues["bare"] == [] and "Confidence is zero" in issues["none"]


def test_extracted_json_is_that_of_the_patterns(spark):
    """Splits and searches find what the patterns found, and cut texts are not read from each brace."""
    from pyspark.sql import functions as F
    from tracefold.operators import recommend as R
    texts = ['{"a": 1}', ' \n{"a": 2}\t', 'x ```json\n{"a": 3}\n``` y', 'x ```JSON {"a": 4} ```', '``````{"a": 5}```',
             '```\nno\n``` ```\n{"a": 6}\n\n```', '````{"a": 7}```', 'p {"a": 8} q', 'p } {"a": 9', '} {', '{"a": 10} ```json {"a": 11}',
             '```json```{"a": 12}', '```jso{"a": 13}```', '', '   ', '{', '{"a": {"b": 14}} ```{"a": 15}``` }', '[{"a": 16}]',
             "é ```json\r\n{\"a\": \"é\"}\r\n``` é {", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    s = F.trim(F.regexp_replace("t", r"^\s+|\s+$", ""))
    valid = lambda c: F.try_parse_json(c).isNotNull()
    fenced = F.filter(F.transform(F.regexp_extract_all(s, F.lit(R.FENCED_RE), 1), lambda b: F.trim(b)), valid)
    braced = F.filter(F.regexp_extract_all(s, F.lit(R.BRACED_RE), 0), valid)
    old = F.coalesce(F.when(s.startswith("{") & valid(s), s), F.try_element_at(fenced, F.lit(1)), F.try_element_at(braced, F.lit(1)))
    for r in df.select("t", old.alias("old"), R.extract_json(F.col("t")).alias("new"), F.to_json(F.try_parse_json(old)).alias("old_v"),
                       F.to_json(R.extract_variant(F.col("t"))).alias("new_v")).collect():
        assert (r.new, r.new_v) == (r.old, r.old_v), r
    plan = df.select(R.extract_variant(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower()

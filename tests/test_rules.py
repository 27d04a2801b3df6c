"""S7, J6 and J5 on rule tables."""

from collections import Counter

import pytest
from conftest import SF_ORACLE
from pyspark.sql import functions as F

from tracefold.operators import decide as D
from tracefold.operators import rules as R
from tracefold.plans import registry

DOC = ('{"allowed_commands": ["kubectl", "ls"], "blocked_patterns": ["helm delete", "^kubectl delete ns"], "matrix_overrides": '
       '[{"environment": "DEV", "scope": "INFRA", "level": "BLOCKED"}, {"environment": "DEV", "scope": "INFRA", "level": "SAFE"}, '
       '{"environment": "PROD", "scope": "CONFIG"}, {"environment": "PROD", "scope": "INFRA", "level": "SAFE"}]}')


@pytest.fixture(scope="module")
def loaded(spark):
    docs = spark.createDataFrame([("t1", DOC), ("t2", "{broken"), ("t3", "[1, 2]"), ("t4", "{}"), ("t5", None)],
                                 "tenant string, json string")
    return R.load_rules(docs)


def test_documents_become_tables_and_bad_ones_nothing(spark, loaded, tmp_path):
    rules, overrides = loaded
    assert sorted(map(tuple, rules.collect())) == [
        ("t1", 0, "allow", "kubectl"), ("t1", 0, "block", "helm delete"), ("t1", 1, "allow", "ls"), ("t1", 1, "block", "^kubectl delete ns")]
    assert [tuple(r) for r in overrides.orderBy("rule_no").collect()][2] == ("t1", 2, "PROD", "CONFIG", "REQUIRE_APPROVAL")
    assert R.read_rule_documents(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "t9.json").write_text(DOC)
    assert [r["tenant"] for r in R.read_rule_documents(spark, str(tmp_path)).collect()] == ["t9"]


def test_matrix_takes_the_first_override_of_the_tenant(spark, loaded):
    rows = [(t, e, s, m) for t in ("t1", "t2") for e in ("DEV", "PROD", "UNKNOWN") for s in ("SOURCE_CODE", "INFRA", "CONFIG")
            for m in ("DIRECT_APPLY", "AUTO_PR")]
    df = spark.createDataFrame(rows, "tenant string, environment string, scope string, execution_mode string")
    got = {(r["tenant"], r["environment"], r["scope"], r["execution_mode"]): (r["matrix_level"], r["matrix_rule"])
           for r in R.with_matrix(df, loaded[1]).collect()}
    assert got["t1", "DEV", "INFRA", "AUTO_PR"] == ("BLOCKED", "user") and got["t1", "PROD", "INFRA", "DIRECT_APPLY"] == ("SAFE", "user")
    assert got["t2", "DEV", "INFRA", "DIRECT_APPLY"] == ("SAFE", "system")
    plain = {k: v[0] for k, v in got.items() if k[0] == "t2"}
    column = {tuple(r)[:4]: r["l"] for r in df.withColumn("l", D.safety_matrix(
        F.col("environment"), F.col("scope"), F.col("execution_mode"), D.SafetyRules())).collect() if r["tenant"] == "t2"}
    assert plain == column


CASES = {"git add .": ("BLOCKED", "system"), "helm delete x": ("BLOCKED", "user"), "kubectl get pods": ("SAFE", "user"),
         "kubectl delete ns a": ("BLOCKED", "user"), "  ls -la ": ("SAFE", "user"), "cat a | grep b": ("REQUIRE_APPROVAL", "system"),
         "cat a": ("SAFE", "system"), "rm x": ("REQUIRE_APPROVAL", "system"), "terraform apply": ("REQUIRE_APPROVAL", "default"),
         "": ("REQUIRE_APPROVAL", "default"), None: ("REQUIRE_APPROVAL", "default"), "echo hi > /etc/x": ("BLOCKED", "system"),
         ":(){ :|:& };:": ("BLOCKED", "system")}


def test_commands_by_precedence(spark, loaded):
    df = spark.createDataFrame([("t1", c, None) for c in CASES], "tenant string, command string, matrix_level string")
    got = {r["command"]: (r["level"], r["decided_by"]) for r in R.classify(df, loaded[0]).collect()}
    assert got == CASES
    # a matrix level stops before allow and safe lists, after block lists
    for level, by in (("REQUIRE_APPROVAL", "matrix"), ("BLOCKED", "matrix")):
        stopped = {r["command"]: (r["level"], r["decided_by"])
                   for r in R.classify(df.withColumn("matrix_level", F.lit(level)), loaded[0]).collect()}
        assert stopped["kubectl get pods"] == stopped["cat a"] == (level, by) and stopped["helm delete x"] == ("BLOCKED", "user")
    # tables and columns agree where a tenant has no rules
    other = {r["command"]: r["level"] for r in R.classify(df.withColumn("tenant", F.lit("t4")), loaded[0]).collect()}
    assert other == {r["command"]: r["l"] for r in df.withColumn("l", D.classify_command(F.col("command"), D.SafetyRules())).collect()}


def test_every_level_and_origin_occurs_in_the_queries(spark):
    q = registry.queries()
    j6 = Counter((r["matrix_level"], r["matrix_rule"]) for r in q["J6_safety_matrix"](spark, SF_ORACLE).collect())
    assert len(j6) == 6
    j5 = Counter((r["level"], r["decided_by"]) for r in q["J5_classify_commands"](spark, SF_ORACLE).collect())
    assert {k for k in j5} >= {("SAFE", "user"), ("SAFE", "system"), ("BLOCKED", "user"), ("BLOCKED", "system"),
                               ("BLOCKED", "matrix"), ("REQUIRE_APPROVAL", "matrix"), ("REQUIRE_APPROVAL", "default")}


def test_command_rules_need_no_nested_loop_over_tenants(spark, loaded):
    df = spark.createDataFrame([("t1", "ls", None)], "tenant string, command string, matrix_level string")
    rules = loaded[0].where("kind = 'block'").withColumnRenamed("tenant", "t")
    joined = df.join(rules, (F.col("tenant") == F.col("t")) & F.expr("command rlike pattern"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

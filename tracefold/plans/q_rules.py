"""Registered queries: safety rule documents (S7), matrix (J6), commands.

Stand-in input, from every row of ``events``: one command with its context per
event, and a rule configuration per service with block patterns, allowed words
and matrix overrides from that service's users.  The configurations are written
as JSON documents, one file per service, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators import decide as D
from tracefold.operators import rules as R
from tracefold.plans.registry import register
from tracefold.session import delete_on_exit, ensure_checkpoint_dir, table

_SERVICE = ("CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service' "
            "WHEN 2 THEN 'order-service' WHEN 3 THEN 'api-gateway' ELSE 'frontend-web' END")
_ENV = "CASE CAST({0} % 3 AS INT) WHEN 0 THEN 'DEV' WHEN 1 THEN 'PROD' ELSE 'UNKNOWN' END"
_SCOPE = "CASE CAST({0} % 4 AS INT) WHEN 0 THEN 'SOURCE_CODE' WHEN 1 THEN 'INFRA' WHEN 2 THEN 'CONFIG' ELSE 'UNKNOWN' END"

COMMANDS_SQL = f"""
SELECT event_id AS command_id, {_SERVICE} AS tenant, {_ENV.format('user_id')} AS environment, {_SCOPE.format('event_id')} AS scope,
  CASE WHEN event_id % 7 < 2 THEN 'AUTO_PR' ELSE 'DIRECT_APPLY' END AS execution_mode,
  CASE event_type
    WHEN 'view' THEN concat('kubectl get pods -n ns-', CAST(user_id % 50 AS STRING))
    WHEN 'click' THEN concat('  ls   -la /srv/app-', CAST(user_id % 50 AS STRING), CASE WHEN event_id % 5 = 0 THEN ' | wc -l' ELSE '' END)
    WHEN 'purchase' THEN concat('helm upgrade release-', CAST(user_id % 50 AS STRING), ' -n ns-', CAST(event_id % 50 AS STRING))
    WHEN 'signup' THEN concat(CASE WHEN event_id % 3 = 0 THEN 'git add .' WHEN event_id % 3 = 1 THEN 'terraform plan' ELSE 'echo created' END,
      CASE WHEN event_id % 11 = 0 THEN ' > /etc/hosts' ELSE ' ' END)
    ELSE CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'rm -rf /' WHEN 1 THEN concat('dd if=/dev/zero of=/dev/sd', CAST(user_id % 50 AS STRING))
      WHEN 2 THEN 'cat app.log' WHEN 3 THEN concat('chmod 777 /srv/app-', CAST(user_id % 50 AS STRING)) WHEN 4 THEN ' '
      ELSE 'touch /tmp/retry' END END AS command
FROM {{events}}"""

#: rules in the order of their user
BLOCKS_SQL = f"""
SELECT tenant, CAST(row_number() OVER (PARTITION BY tenant ORDER BY user_id) - 1 AS BIGINT) AS rule_no, pattern FROM (
  SELECT DISTINCT {_SERVICE} AS tenant, user_id, concat('-n ns-', CAST(user_id % 50 AS STRING), '$') AS pattern
  FROM {{events}} WHERE user_id % 4 = 0) s"""
ALLOWS_SQL = f"""
SELECT tenant, CAST(row_number() OVER (PARTITION BY tenant ORDER BY word) - 1 AS BIGINT) AS rule_no, word AS pattern FROM (
  SELECT DISTINCT {_SERVICE} AS tenant, CASE WHEN user_id % 5 < 2 THEN 'helm' WHEN user_id % 5 = 2 THEN 'kubectl' ELSE 'terraform' END AS word
  FROM {{events}} WHERE event_type = 'signup') s"""
OVERRIDES_SQL = f"""
SELECT tenant, CAST(row_number() OVER (PARTITION BY tenant ORDER BY user_id) - 1 AS BIGINT) AS rule_no, environment, scope, level FROM (
  SELECT DISTINCT {_SERVICE} AS tenant, user_id, {_ENV.format('user_id')} AS environment,
    {_SCOPE.format('CAST(floor(user_id / 3) AS BIGINT)')} AS scope,
    CASE WHEN user_id % 8 < 3 THEN 'SAFE' WHEN user_id % 8 = 3 THEN 'BLOCKED' WHEN user_id % 8 < 6 THEN 'REQUIRE_APPROVAL' END AS level
  FROM {{events}} WHERE event_type = 'purchase' AND (user_id % 7 = 0 OR user_id % 11 = 0)) s"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


def commands(spark, sf_dir) -> DataFrame:
    return spark.sql(COMMANDS_SQL, events=_events(spark, sf_dir))


def rule_documents(spark, sf_dir) -> str:
    """The folder of the configurations: one JSON document per service, and one that is damaged."""
    e = _events(spark, sf_dir)

    def listed(sql: str, value, name: str) -> DataFrame:
        rows = spark.sql(sql, events=e)
        return rows.groupBy("tenant").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", value.alias("v")))),
                                                      lambda x: x["v"]).alias(name))

    docs = listed(BLOCKS_SQL, F.col("pattern"), "blocked_patterns").join(
        listed(ALLOWS_SQL, F.col("pattern"), "allowed_commands"), "tenant", "full").join(
        listed(OVERRIDES_SQL, F.struct("environment", "scope", "level"), "matrix_overrides"), "tenant", "full")
    base = delete_on_exit(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tracefold-rules-{uuid.uuid4().hex[:12]}")
    text = docs.select("tenant", F.to_json(F.struct("allowed_commands", "blocked_patterns", "matrix_overrides")).alias("json"))
    damaged = e.select(F.lit("damaged").alias("tenant"), F.lit('{"allowed_commands": ["rm"').alias("json")).limit(1)
    text.unionByName(damaged).repartition("tenant").sortWithinPartitions("tenant").write.partitionBy("tenant").text(base)
    return base


def _read_rules(spark, sf_dir):
    base = rule_documents(spark, sf_dir)
    docs = spark.read.text(f"{base}/*/*.txt", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"tenant=([^/]+)/", 1).alias("tenant"), F.col("value").alias("json"))
    return R.load_rules(docs)


def _sql(body: str) -> str:
    return body.replace("{events}", "events")


_RULE_CTES = f"""
WITH cmds AS ({_sql(COMMANDS_SQL)}),
blocks AS MATERIALIZED ({_sql(BLOCKS_SQL)}),
allows AS MATERIALIZED ({_sql(ALLOWS_SQL)}),
overrides AS MATERIALIZED ({_sql(OVERRIDES_SQL)})"""

_MATRIX_CTES = _RULE_CTES + """,
firsts AS (SELECT tenant, environment, scope, arg_min(coalesce(level, 'REQUIRE_APPROVAL'), rule_no) AS level FROM overrides
  GROUP BY tenant, environment, scope),
matrix AS (SELECT c.*, CASE WHEN f.level IS NOT NULL THEN 'user' ELSE 'system' END AS matrix_rule,
  CASE WHEN f.level IS NOT NULL THEN f.level WHEN c.scope = 'SOURCE_CODE' AND execution_mode = 'DIRECT_APPLY' THEN 'BLOCKED'
    WHEN c.scope = 'INFRA' AND c.environment = 'DEV' AND execution_mode = 'DIRECT_APPLY' THEN 'SAFE' ELSE 'REQUIRE_APPROVAL' END
    AS matrix_level
  FROM cmds c LEFT JOIN firsts f ON c.tenant = f.tenant AND c.environment = f.environment AND c.scope = f.scope)"""


@register("S7_load_safety_rules", _RULE_CTES + """
SELECT tenant, 'block' AS kind, rule_no, pattern, NULL AS environment, NULL AS scope, NULL AS level FROM blocks
UNION ALL SELECT tenant, 'allow', rule_no, pattern, NULL, NULL, NULL FROM allows
UNION ALL SELECT tenant, 'override', rule_no, NULL, environment, scope, coalesce(level, 'REQUIRE_APPROVAL') FROM overrides""")
def q_load_safety_rules(spark, sf_dir):
    rules, overrides = _read_rules(spark, sf_dir)
    return rules.unionByName(overrides.withColumn("kind", F.lit("override")), allowMissingColumns=True).select(
        "tenant", "kind", "rule_no", "pattern", "environment", "scope", "level")


@register("J6_safety_matrix", _MATRIX_CTES + """
SELECT command_id, environment, scope, execution_mode, matrix_level, matrix_rule FROM matrix""")
def q_safety_matrix(spark, sf_dir):
    _, overrides = _read_rules(spark, sf_dir)
    m = R.with_matrix(commands(spark, sf_dir), overrides)
    return m.select("command_id", "environment", "scope", "execution_mode", "matrix_level", "matrix_rule")


def _values(rows) -> str:
    return ", ".join("({}, '{}', '{}')".format(n, p.replace("'", "''"), lvl) for n, (p, lvl) in enumerate(rows))


@register("J5_classify_commands", _MATRIX_CTES + f""",
sysb AS (SELECT * FROM (VALUES {_values([(p, D.BLOCKED) for p in D.BLOCKED_PATTERNS])}) v(rule_no, pattern, level)),
sysw AS (SELECT * FROM (VALUES {_values([(w, D.SAFE) for w in D.SAFE_COMMANDS] + [(w, D.APPROVAL) for w in D.APPROVAL_COMMANDS])})
  v(rule_no, pattern, level)),
m AS (SELECT *, trim(regexp_replace(command, '\\s+', ' ', 'g')) AS squeezed, regexp_replace(command, '^\\s+|\\s+$', '', 'g') AS c
  FROM matrix),
d AS (SELECT DISTINCT tenant, c, string_split(squeezed, ' ')[1] AS base FROM m WHERE c <> ''),
ub AS (SELECT d.tenant, c, arg_min(pattern, rule_no) AS p FROM d JOIN blocks b ON d.tenant = b.tenant AND regexp_matches(c, pattern)
  GROUP BY d.tenant, c),
sb AS (SELECT tenant, c, arg_min(pattern, rule_no) AS p FROM d JOIN sysb ON regexp_matches(c, pattern) GROUP BY tenant, c),
ua AS (SELECT DISTINCT d.tenant, c, pattern AS p FROM d JOIN allows a ON d.tenant = a.tenant AND base = pattern),
sw AS (SELECT tenant, c, pattern AS p, CASE WHEN contains(c, '>') OR contains(c, '|') THEN 'REQUIRE_APPROVAL' ELSE level END AS level
  FROM d JOIN sysw ON base = pattern),
j AS (SELECT m.*, ub.p AS ubp, sb.p AS sbp, ua.p AS uap, sw.p AS swp, sw.level AS swl FROM m
  LEFT JOIN ub USING (tenant, c) LEFT JOIN sb USING (tenant, c) LEFT JOIN ua USING (tenant, c) LEFT JOIN sw USING (tenant, c))
SELECT command_id, command,
  CASE WHEN c = '' THEN 'REQUIRE_APPROVAL' WHEN ubp IS NOT NULL OR sbp IS NOT NULL THEN 'BLOCKED' WHEN matrix_level <> 'SAFE' THEN
    matrix_level WHEN uap IS NOT NULL THEN 'SAFE' ELSE coalesce(swl, 'REQUIRE_APPROVAL') END AS level,
  CASE WHEN c = '' THEN 'default' WHEN ubp IS NOT NULL THEN 'user' WHEN sbp IS NOT NULL THEN 'system' WHEN matrix_level <> 'SAFE' THEN
    'matrix' WHEN uap IS NOT NULL THEN 'user' WHEN swp IS NOT NULL THEN 'system' ELSE 'default' END AS decided_by,
  CASE WHEN c = '' THEN NULL WHEN ubp IS NOT NULL THEN ubp WHEN sbp IS NOT NULL THEN sbp WHEN matrix_level <> 'SAFE' THEN NULL
    ELSE coalesce(uap, swp) END AS rule
FROM j""")
def q_classify_commands(spark, sf_dir):
    rules, overrides = _read_rules(spark, sf_dir)
    return R.classify(R.with_matrix(commands(spark, sf_dir), overrides), rules).select(
        "command_id", "command", "level", "decided_by", "rule")

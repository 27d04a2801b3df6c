"""Remediation decisions as table jobs: S6 feedback, A8 success rates, J4
history join, G1 confidence decision, S7 safety rules, J6 safety matrix, J5
command classification, G2 audit roll-up.

Proposals and feedback are tables; the safety configuration is a small rule
list (a config file), folded into native CASE / rlike expressions on the
driver, so classification is a projection over the command table with no join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
HIGH_CONFIDENCE = 0.99
LOW_CONFIDENCE = 0.80
RUNTIME_OP_THRESHOLD = 0.70
AI_WEIGHT, HISTORY_WEIGHT = 0.4, 0.6
MIN_FEEDBACK_SAMPLES = 3

SAFE, APPROVAL, BLOCKED = "SAFE", "REQUIRE_APPROVAL", "BLOCKED"
REASON_LOW = "Low confidence (< {}). Forcing HITL."
REASON_NO_HISTORY = "High AI confidence but no historical verification. Requesting first-time approval."
REASON_VERIFIED = "High confidence + Verified history."
REASON_MEDIUM = "Confidence in medium range (0.8-0.9). Requesting approval."

SAFE_COMMANDS = ["ls", "grep", "cat", "echo", "pwd",
                 "kubectl get", "kubectl describe", "kubectl logs",
                 "git status", "git log", "git diff"]
APPROVAL_COMMANDS = ["kubectl delete", "kubectl scale", "kubectl patch", "kubectl apply",
                     "rm", "mv", "cp", "touch", "mkdir",
                     "git commit", "git push", "git merge",
                     "systemctl restart", "docker stop", "docker restart"]
# System block list as Java regex.  The last entry is the reference's fork-bomb
# text read the way its regex engine reads it: an empty group, literal braces
# and a top-level alternation (Java needs the braces escaped).
BLOCKED_PATTERNS = [r"rm -rf /$", r"rm -rf /\*", r">\s*/etc/", r"chmod 777", r"mkfs", r"dd ",
                    r":()\{ :|:& \};:"]

ACTION_TYPES = ["COMMAND", "PATCH", "API_CALL", "FILE_EDIT", "XML_EDIT", "RUNTIME_OP"]
# ---------------------------------------------------------------------------

FEEDBACK_JSON_SCHEMA = T.MapType(T.StringType(), T.StructType([
    T.StructField("success", T.LongType()), T.StructField("total", T.LongType())]))


@dataclass
class SafetyRules:
    """User safety configuration (allowed base commands, blocked regexes,
    matrix overrides in rule order)."""
    allowed_commands: list[str] = field(default_factory=list)
    blocked_patterns: list[str] = field(default_factory=list)
    matrix_overrides: list[dict] = field(default_factory=list)


def load_safety_rules(path: str | None) -> SafetyRules:
    """Read the JSON config; a missing or unreadable file gives empty rules."""
    if not path:
        return SafetyRules()
    try:
        with open(path) as f:
            data = json.load(f)
        return SafetyRules(sorted(set(data.get("allowed_commands", []))), list(data.get("blocked_patterns", [])),
                           list(data.get("matrix_overrides", [])))
    except (OSError, ValueError, AttributeError):
        return SafetyRules()


def load_feedback(docs: DataFrame, json_col: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """``{"title": {"success": n, "total": m}}`` documents -> rows
    ``(*keep, signature, success, total)``."""
    m = F.from_json(F.col(json_col), FEEDBACK_JSON_SCHEMA)
    return docs.select(*keep, F.explode(m).alias("signature", "c")).select(
        *keep, "signature", F.col("c.success").alias("success"), F.col("c.total").alias("total"))


def success_rates(counts: DataFrame) -> DataFrame:
    """Success / total per signature; NULL below the minimum sample size."""
    return counts.withColumn("success_rate", F.when(F.col("total") >= MIN_FEEDBACK_SAMPLES,
                                                    F.col("success") / F.col("total")))


def attach_history(proposals: DataFrame, rates: DataFrame, title: str = "title", as_of: str | None = None) -> DataFrame:
    """Left outer join of proposals to the success rate of their title; with
    ``as_of`` (a column of both, such as the day) to the rate known then."""
    r = rates.select(F.col("signature").alias("__sig"), *([F.col(as_of).alias("__as_of")] if as_of else []),
                     F.col("success_rate").alias("history_score"))
    on = proposals[title] == r["__sig"]
    if as_of:
        on = on & (proposals[as_of] == r["__as_of"])
    return proposals.join(r, on, "left").drop("__sig", "__as_of")


def _fmt_threshold(t: float) -> str:
    return repr(float(t))


def score_proposals(proposals: DataFrame, ai: str = "ai_confidence", actions: str = "actions") -> DataFrame:
    """G1: final score, decision and reason per proposal (after J4)."""
    hist = F.col("history_score")
    final = F.when(hist.isNotNull(), F.col(ai) * AI_WEIGHT + hist * HISTORY_WEIGHT).otherwise(F.col(ai))
    has_runtime = F.coalesce(F.exists(F.col(actions), lambda a: a["type"] == "RUNTIME_OP"), F.lit(False))
    thr = F.when(has_runtime, F.lit(RUNTIME_OP_THRESHOLD)).otherwise(F.lit(LOW_CONFIDENCE))
    low_reason = F.when(has_runtime, F.lit(REASON_LOW.format(_fmt_threshold(RUNTIME_OP_THRESHOLD)))).otherwise(
        F.lit(REASON_LOW.format(_fmt_threshold(LOW_CONFIDENCE))))
    p = proposals.withColumn("final_score", final).withColumn("threshold", thr)
    fs = F.col("final_score")
    decision = (F.when(fs < F.col("threshold"), F.lit(APPROVAL))
                .when((fs >= HIGH_CONFIDENCE) & hist.isNull(), F.lit(APPROVAL))
                .when(fs >= HIGH_CONFIDENCE, F.lit(SAFE)).otherwise(F.lit(APPROVAL)))
    reason = (F.when(fs < F.col("threshold"), low_reason)
              .when((fs >= HIGH_CONFIDENCE) & hist.isNull(), F.lit(REASON_NO_HISTORY))
              .when(fs >= HIGH_CONFIDENCE, F.lit(REASON_VERIFIED)).otherwise(F.lit(REASON_MEDIUM)))
    return p.withColumn("decision", decision).withColumn("reason", reason)


def safety_matrix(environment: Column, scope: Column, mode: Column, rules: SafetyRules) -> Column:
    """User overrides on (environment, scope) first (first match wins),
    then the fixed matrix."""
    expr = None
    for r in rules.matrix_overrides:
        cond = (environment == F.lit(r.get("environment"))) & (scope == F.lit(r.get("scope")))
        lvl = F.lit(r.get("level", APPROVAL))
        expr = F.when(cond, lvl) if expr is None else expr.when(cond, lvl)
    fixed = [((scope == "SOURCE_CODE") & (mode == "DIRECT_APPLY"), BLOCKED),
             ((scope == "SOURCE_CODE") & (mode == "AUTO_PR"), APPROVAL),
             ((scope == "INFRA") & (environment == "PROD") & (mode == "DIRECT_APPLY"), APPROVAL),
             ((scope == "INFRA") & (environment == "DEV") & (mode == "DIRECT_APPLY"), SAFE)]
    for cond, lvl in fixed:
        expr = F.when(cond, F.lit(lvl)) if expr is None else expr.when(cond, F.lit(lvl))
    return expr.otherwise(F.lit(APPROVAL))


def _any_rlike(c: Column, patterns) -> Column:
    if not patterns:
        return F.lit(False)
    out = c.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | c.rlike(p)
    return out


def base_command(cmd: Column) -> Column:
    """First whitespace-separated word of the stripped command."""
    return F.element_at(F.split(F.trim(F.regexp_replace(cmd, r"\s+", " ")), " "), 1)


def _level_case(c: Column, base: Column, rules: SafetyRules, matrix: Column | None) -> Column:
    expr = F.when(c.isNull() | (c == ""), F.lit(APPROVAL))
    expr = expr.when(_any_rlike(c, rules.blocked_patterns), F.lit(BLOCKED))
    expr = expr.when(_any_rlike(c, BLOCKED_PATTERNS), F.lit(BLOCKED))
    if matrix is not None:
        expr = expr.when(matrix == BLOCKED, F.lit(BLOCKED)).when(matrix == APPROVAL, F.lit(APPROVAL))
    if rules.allowed_commands:
        expr = expr.when(base.isin(*rules.allowed_commands), F.lit(SAFE))
    expr = expr.when(base.isin(*SAFE_COMMANDS) & (c.contains(">") | c.contains("|")), F.lit(APPROVAL))
    expr = expr.when(base.isin(*SAFE_COMMANDS), F.lit(SAFE))
    expr = expr.when(base.isin(*APPROVAL_COMMANDS), F.lit(APPROVAL))
    return expr.otherwise(F.lit(APPROVAL))


def _strip(cmd: Column) -> Column:
    return F.regexp_replace(cmd, r"^\s+|\s+$", "")


def classify_command(cmd: Column, rules: SafetyRules, matrix: Column | None = None) -> Column:
    """Safety level of a shell command.  Order: user block list, system
    block list, matrix (BLOCKED or approval stop), user allow list, safe list
    (approval when the command has '>' or '|'), approval list, approval.
    (Column form; ``with_command_level`` computes the same on a frame with the
    stripped command and its base word materialised once.)"""
    c = _strip(cmd)
    return _level_case(c, base_command(c), rules, matrix)


def with_command_level(df: DataFrame, cmd: str, rules: SafetyRules, out: str = "level",
                       matrix: str | None = None, only_if: Column | None = None) -> DataFrame:
    """J5 on a frame: the stripped command and its base word are columns
    (computed once per row), the rule CASE reads those columns."""
    d = df.withColumn("__cmd", _strip(F.col(cmd))).withColumn("__base", base_command(F.col("__cmd")))
    lvl = _level_case(F.col("__cmd"), F.col("__base"), rules, F.col(matrix) if matrix else None)
    if only_if is not None:
        lvl = F.when(only_if, lvl)
    return d.withColumn(out, lvl).drop("__cmd", "__base")


def action_command_text(action: Column) -> Column:
    """The string the agent runs for an action: COMMAND = command + ' ' +
    arguments (space kept even without arguments); FILE_EDIT = 'EDIT_FILE
    path: command'; other types = command."""
    args = F.coalesce(F.array_join(action["arguments"], " "), F.lit(""))
    return (F.when(action["type"] == "COMMAND", F.concat(action["command"], F.lit(" "), args))
            .when(action["type"] == "FILE_EDIT",
                  F.concat(F.lit("EDIT_FILE "), F.coalesce(action["file_path"], F.lit("None")), F.lit(": "),
                           action["command"]))
            .otherwise(action["command"]))


def audit_commands(scored: DataFrame, keys: tuple[str, ...] = ("proposal_id",), rules: SafetyRules | None = None,
                   git_user: str | None = "git_user", git_email: str | None = "git_email") -> DataFrame:
    """What the agent would do with each scored proposal.  Only a SAFE
    decision reaches the per-command block check, which skips FILE_EDIT,
    XML_EDIT and RUNTIME_OP and passes no context (the matrix is unused);
    malformed file edits count as failures.  Nothing is executed."""
    rules = rules or SafetyRules()
    keys = list(keys)
    acts = scored.select(*keys, "decision", "git_user", "git_email",
                         F.posexplode_outer("actions").alias("pos", "a"))
    acts = acts.withColumn("__text", action_command_text(F.col("a")))
    stripped = _strip(F.col("__text"))
    is_git = stripped.startswith("git ") & F.col("git_user").isNotNull()
    acts = acts.withColumn("__run", F.when(is_git, F.concat(
        F.lit("git -c user.name='"), F.col("git_user"), F.lit("' -c user.email='"), F.col("git_email"), F.lit("' "),
        F.substring(stripped, 5, 1 << 30))).otherwise(F.col("__text")))
    checked = F.col("a.type").isin("COMMAND", "PATCH", "API_CALL")
    acts = with_command_level(acts, "__run", rules, out="__level", only_if=checked)
    level = F.col("__level")
    malformed = ((F.col("a.type") == "FILE_EDIT") & (F.col("a.file_path").isNull() | F.col("a.original_context").isNull()
                                                     | F.col("a.replacement_text").isNull())) | (
        (F.col("a.type") == "XML_EDIT") & (F.col("a.file_path").isNull() | F.col("a.xml_selector").isNull()
                                           | F.col("a.xml_value").isNull()))
    per = acts.select(*keys, "decision", F.col("a").isNotNull().alias("has"), (level == BLOCKED).alias("blocked"),
                      malformed.alias("malformed"), F.when(level == BLOCKED, F.col("__run")).alias("blocked_cmd"), "pos")
    g = per.groupBy(*keys, "decision").agg(
        F.count_if(F.col("has")).alias("n_actions"),
        F.count_if(F.coalesce(F.col("blocked"), F.lit(False))).alias("n_blocked"),
        F.count_if(F.coalesce(F.col("malformed"), F.lit(False))).alias("n_malformed"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("blocked_cmd").isNotNull(),
                                                       F.struct("pos", "blocked_cmd")))),
                    lambda s: s["blocked_cmd"]).alias("blocked_commands"))
    executed = F.col("decision") == SAFE
    return g.withColumn("executed", executed).withColumn(
        "success", F.when(executed, (F.col("n_blocked") == 0) & (F.col("n_malformed") == 0)))

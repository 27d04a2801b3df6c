"""Model replies -> recommendations -> responses: P12 parse, P13 proposals,
P14 actions, P15 validation, P16 incident response, A9 run metrics, A11
similar case ids, W11 running latency.

Reply parsing is native: the JSON candidate is chosen with
``try_parse_json`` over (1) the whole text, (2) fenced blocks, (3) the widest
``{...}`` span.  It is parsed once into a VARIANT, which is cast to the model's
tree; free-form members (evidence, states, decision factors, metadata) stay
VARIANT.  A missing required part, or one of another type, makes the row degraded
(the reference falls back to a canned degraded recommendation).  Values that the
model fills from the clock or at random are NULL, or hashes of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.scan import numeric_bucket, running_sum

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
FENCED_RE = r"(?i)```(?:json)?\s*\n?([\s\S]*?)\n?```"
BRACED_RE = r"\{[\s\S]*\}"
DEGRADED_SUMMARY = "Analysis failed due to model unavailability"
DEGRADED_CAUSE = "unknown"
DEGRADED_ACTION = "manual_review"
DEGRADED_RISK = "unknown"
DEGRADED_REASONING = "Model failure"
AUTO_APPLY_THRESHOLD = 0.85
LOW_AUTO_HEAL = 0.7
HIGH_RISK_LEVELS = ["high", "critical", "unknown"]
SEVERITY_MAP = [("critical", "critical"), ("high", "high"), ("medium", "medium"), ("moderate", "medium"),
                ("low", "low"), ("unknown", "high")]
ISSUE_UNKNOWN_CAUSE = "Root cause is unknown or missing"
ISSUE_NO_RECS = "No recommendations provided"
ISSUE_ZERO_CONF = "Confidence is zero"
ISSUE_AUTO_HEAL = "Auto-heal candidate with low confidence"
PLAN_DEFAULTS = {"title": "Unknown Plan", "reasoning": "No reasoning provided",
                 "validation_strategy": "Manual verification", "risk_assessment": "High"}
ACTION_TYPES = ["COMMAND", "PATCH", "API_CALL", "FILE_EDIT", "XML_EDIT", "RUNTIME_OP"]
# ---------------------------------------------------------------------------

S, D, L, B, V = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.VariantType()
_arr = T.ArrayType

FILE_EDIT = T.StructType([T.StructField(n, S) for n in ("file_path", "original_context", "replacement_text",
                                                          "xml_selector", "xml_value")])
IMPLEMENTATION = T.StructType([T.StructField("type", S), T.StructField("commands", _arr(S)),
                               T.StructField("file_edits", _arr(FILE_EDIT)), T.StructField("pre_checks", _arr(S)),
                               T.StructField("post_checks", _arr(S))])
ROLLBACK = T.StructType([T.StructField("commands", _arr(S)), T.StructField("automatic_rollback_if", _arr(S)),
                         T.StructField("rollback_time_seconds", L)])
SIMILAR_CASE = T.StructType([T.StructField("incident_id", S), T.StructField("similarity", D),
                             T.StructField("fix_applied", S), T.StructField("outcome", S),
                             T.StructField("resolution_time_minutes", L)])
RECOMMENDATION = T.StructType([
    T.StructField("rank", L), T.StructField("recommendation_id", S), T.StructField("title", S), T.StructField("description", S),
    T.StructField("fix_type", S), T.StructField("estimated_effort", S), T.StructField("estimated_time_minutes", L),
    T.StructField("risk_level", S), T.StructField("cost_impact", S), T.StructField("implementation", IMPLEMENTATION),
    T.StructField("current_state", V), T.StructField("target_state", V),
    T.StructField("rollback", ROLLBACK), T.StructField("reasoning", S), T.StructField("side_effects", _arr(S)),
    T.StructField("ai_confidence", D), T.StructField("similar_cases", _arr(SIMILAR_CASE))])
CAUSAL_STEP = T.StructType([
    T.StructField("step", L), T.StructField("event", S), T.StructField("timestamp", S), T.StructField("metric", S),
    *[T.StructField(n, D) for n in ("value", "normal", "anomaly_score", "max", "wait_time_ms")],
    T.StructField("affected_requests", L)])
RCA = T.StructType([T.StructField("summary", S), T.StructField("primary_cause", S),
                    T.StructField("contributing_factors", _arr(S)), T.StructField("timeline", _arr(S)),
                    T.StructField("evidence", V), T.StructField("impact", S)])
CONFIDENCE = T.StructType([
    T.StructField("final_confidence", D), T.StructField("action", S), T.StructField("threshold_used", D),
    T.StructField("risk_level", S), T.StructField("breakdown", T.MapType(S, D)),
    T.StructField("adjustments", T.MapType(S, _arr(S))), T.StructField("reasoning", S),
    T.StructField("decision_factors", V)])
REPLY = T.StructType([
    T.StructField("incident_id", S), T.StructField("analysis_id", S), T.StructField("analyzed_at", S),
    T.StructField("processing_time_ms", D), T.StructField("metadata", V),
    T.StructField("root_cause_analysis", RCA), T.StructField("causal_chain", _arr(CAUSAL_STEP)),
    T.StructField("recommendations", _arr(RECOMMENDATION)), T.StructField("confidence_assessment", CONFIDENCE),
    T.StructField("requires_human_review", B), T.StructField("auto_heal_candidate", B)])
PROPOSAL = T.StructType([
    T.StructField("plan", T.StructType([T.StructField(n, S) for n in PLAN_DEFAULTS])),
    T.StructField("actions", _arr(T.StructType([T.StructField("type", S), T.StructField("command", S),
                                                  T.StructField("arguments", _arr(S)),
                                                  T.StructField("context", S)]))),
    T.StructField("confidence_score", D)])


def _frozen(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed at this point, once a row: what is selected or
    exploded later reads them instead of repeating the parse for every use."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__x")).select("__x.*")


def _valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


_SPACE = " \t\n\x0b\f\r"


def _stripped(text: Column) -> Column:
    """``text`` without white space at its ends; native, as it stands in several branches."""
    return F.btrim(text, F.lit(_SPACE))


def _blocks(t: Column) -> Column:
    """The matches of ``FENCED_RE``: every second part between fences, the last part is
    never closed.  A split, as the pattern tries its end at each character."""
    parts = F.split(t, "```", -1)
    closed = F.filter(parts, lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1))

    def inner(p: Column) -> Column:
        p = F.ltrim(F.when(F.lower(F.left(p, F.lit(4))) == "json", F.substring(p, F.lit(5), F.length(p))).otherwise(p),
                    F.lit(_SPACE))
        return F.trim(F.when(p.endswith("\n"), F.left(p, F.length(p) - 1)).otherwise(p))

    return F.when(t.contains("```"), F.transform(closed, inner))


def _widest(t: Column) -> Column:
    """The one match of ``BRACED_RE``: from the first ``{`` to the last ``}``.  Two
    searches; the pattern would read the rest of a cut text again from each ``{``."""
    start, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    return F.when((start > 0) & t.contains("}") & (end > start), F.substring(t, start, end - start + 1))


def extract_json(text: Column) -> Column:
    """The JSON document inside a reply: the whole stripped text if it is a
    JSON object, else the first fenced block that parses, else the widest
    ``{...}`` span that parses; NULL when none does."""
    t = _stripped(text)
    whole = F.when(t.startswith("{") & _valid(t), t)
    fenced = F.try_element_at(F.filter(_blocks(t), _valid), F.lit(1))
    return F.coalesce(whole, fenced, F.when(_valid(_widest(t)), _widest(t)))


def extract_variant(text: Column) -> Column:
    """``extract_json``'s document, parsed: every candidate is parsed once."""
    t = _stripped(text)
    fenced = F.filter(F.transform(_blocks(t), F.try_parse_json), lambda v: v.isNotNull())
    return F.coalesce(F.when(t.startswith("{"), F.try_parse_json(t)), F.try_element_at(fenced, F.lit(1)),
                      F.try_parse_json(_widest(t)))


def _all(arr: Column, pred) -> Column:
    return F.coalesce(F.forall(arr, pred), F.lit(True))


def _required_ok(r: Column) -> Column:
    """Every field the reference model requires is present."""
    rca, ca = r["root_cause_analysis"], r["confidence_assessment"]
    ok = rca.isNotNull() & rca["summary"].isNotNull() & rca["primary_cause"].isNotNull() & rca["impact"].isNotNull()
    ok = ok & r["causal_chain"].isNotNull() & _all(
        r["causal_chain"], lambda s: s["step"].isNotNull() & s["event"].isNotNull() & s["timestamp"].isNotNull())
    req = ("rank", "title", "description", "fix_type", "estimated_effort", "estimated_time_minutes", "risk_level",
           "cost_impact", "reasoning", "ai_confidence")

    def rec_ok(x):
        c = x[req[0]].isNotNull()
        for f in req[1:]:
            c = c & x[f].isNotNull()
        impl = x["implementation"]
        c = c & (impl.isNull() | (impl["type"].isNotNull() & _all(impl["file_edits"], lambda e: e["file_path"].isNotNull()
                                                                 & e["original_context"].isNotNull()
                                                                 & e["replacement_text"].isNotNull())))
        for state in (x["current_state"], x["target_state"]):  # optional: null and absent are the same
            c = c & (state.isNull() | F.is_variant_null(state) | _is_object(state))
        c = c & (x["rollback"].isNull() | x["rollback"]["rollback_time_seconds"].isNotNull())
        return c & _all(x["similar_cases"], lambda s: s["incident_id"].isNotNull() & s["similarity"].isNotNull()
                        & s["fix_applied"].isNotNull() & s["outcome"].isNotNull()
                        & s["resolution_time_minutes"].isNotNull())

    ok = ok & r["recommendations"].isNotNull() & _all(r["recommendations"], rec_ok)
    for f in ("final_confidence", "action", "threshold_used", "risk_level", "breakdown", "adjustments", "reasoning",
              "decision_factors"):
        ok = ok & ca[f].isNotNull()
    for free in (rca["evidence"], r["metadata"]):
        ok = ok & (free.isNull() | _is_object(free))
    ok = ok & _is_object(ca["decision_factors"])
    return ok & r["requires_human_review"].isNotNull() & r["auto_heal_candidate"].isNotNull()


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


EMPTY_OBJECT = "{}"
_NO_TEXTS = "array<string>"


def parse_model_output(replies: DataFrame, key: str = "bundle_id", reply: str = "reply", keep: tuple[str, ...] = ()) -> DataFrame:
    """One recommendation row per reply (and its columns ``keep``) with every part of the model's tree;
    ``degraded`` rows carry the reference's fallback values (confidence 0, review
    required).  Left out lists and objects are empty."""
    r = _frozen(replies.select(key, *keep, reply, extract_variant(F.col(reply)).alias("__v")))
    r = _frozen(r.withColumn("__r", F.try_variant_get("__v", "$", REPLY.simpleString())).drop("__v"))
    r = _frozen(r.withColumn("degraded", F.col("__r").isNull() | ~F.coalesce(_required_ok(F.col("__r")), F.lit(False))))
    deg = F.col("degraded")
    hashed = F.md5(F.col(key).cast("string"))

    def at(path: str) -> Column:
        return F.col(f"__r.{path}")

    def pick(path: str, bad) -> Column:
        return F.when(deg, F.lit(bad)).otherwise(at(path))

    def texts(path: str) -> Column:
        return F.when(~deg, at(path)).otherwise(F.array().cast(_NO_TEXTS))

    def filled(path: str) -> Column:
        return F.coalesce(texts(path), F.array().cast(_NO_TEXTS))

    def free(path: str, bad: str = EMPTY_OBJECT) -> Column:
        return F.coalesce(F.when(~deg, at(path)), F.when(deg, F.parse_json(F.lit(bad))), F.parse_json(F.lit(EMPTY_OBJECT)))

    ca = "confidence_assessment"
    recs = F.transform(at("recommendations"), lambda x, i: x.withField("recommendation_id", F.coalesce(
        x["recommendation_id"], F.concat(F.lit("rec_"), F.substring(F.md5(F.concat(hashed, F.lit("#"), i.cast("string"))), 1, 8)))))
    return _frozen(r.select(
        key, *keep, "degraded", F.when(~deg, at("incident_id")).alias("incident_id"),
        F.coalesce(F.when(~deg, at("analysis_id")), F.concat(F.lit("analysis_"), F.substring(hashed, 1, 12))).alias("analysis_id"),
        F.when(~deg, at("analyzed_at")).alias("analyzed_at"),
        F.coalesce(F.when(~deg, at("processing_time_ms")), F.lit(0.0)).alias("processing_time_ms"),
        pick("root_cause_analysis.summary", DEGRADED_SUMMARY).alias("summary"),
        pick("root_cause_analysis.primary_cause", DEGRADED_CAUSE).alias("primary_cause"),
        pick("root_cause_analysis.impact", DEGRADED_CAUSE).alias("impact"),
        filled("root_cause_analysis.contributing_factors").alias("contributing_factors"),
        filled("root_cause_analysis.timeline").alias("timeline"), free("root_cause_analysis.evidence").alias("evidence"),
        F.when(deg, F.array().cast(_arr(CAUSAL_STEP))).otherwise(at("causal_chain")).alias("causal_chain"),
        F.when(deg, F.array().cast(_arr(RECOMMENDATION))).otherwise(recs).alias("recommendations"),
        pick(f"{ca}.final_confidence", 0.0).alias("final_confidence"), pick(f"{ca}.action", DEGRADED_ACTION).alias("action"),
        pick(f"{ca}.threshold_used", 0.0).alias("threshold_used"), pick(f"{ca}.risk_level", DEGRADED_RISK).alias("risk_level"),
        F.when(deg, F.create_map().cast("map<string,double>")).otherwise(at(f"{ca}.breakdown")).alias("breakdown"),
        F.when(deg, F.from_json(F.lit('{"penalties": [], "bonuses": []}'), "map<string,array<string>>"))
        .otherwise(at(f"{ca}.adjustments")).alias("adjustments"),
        pick(f"{ca}.reasoning", DEGRADED_REASONING).alias("confidence_reasoning"),
        free(f"{ca}.decision_factors").alias("decision_factors"),
        pick("requires_human_review", True).alias("requires_human_review"),
        pick("auto_heal_candidate", False).alias("auto_heal_candidate"),
        free("metadata", '{"error": "All models failed"}').alias("metadata"),
        F.substring(F.col(reply), 1, 5000).alias("raw_model_output")))


def free_members(recs: DataFrame, key: str = "bundle_id") -> DataFrame:
    """(key, part, rec, name, value as JSON): the members of the free-form objects of
    parsed replies; ``rec`` is the recommendation's place for its states, else null."""
    objects = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(None).cast("int").alias("rec"), F.col(p).alias("v"))
                        for p in ("evidence", "decision_factors", "metadata")])
    states = F.flatten(F.transform("recommendations", lambda x, i: F.array(*[
        F.struct(F.lit(p).alias("part"), i.alias("rec"), x[p].alias("v")) for p in ("current_state", "target_state")])))
    rows = recs.select(key, F.explode(F.concat(objects, states)).alias("o")).select(key, "o.*")
    return rows.sparkSession.sql(
        f"SELECT r.`{key}`, r.part, CAST(r.rec AS BIGINT) AS rec, e.key AS name, to_json(e.value) AS value "
        "FROM {rows} r, LATERAL variant_explode(r.v) e", rows=rows)


def parse_proposals(replies: DataFrame, key: str = "bundle_id", reply: str = "reply") -> DataFrame:
    """Reply -> plan (with defaults) + actions; no JSON, bad JSON or an
    unknown action type rejects the whole row (NULL plan)."""
    p = replies.withColumn("__j", extract_json(F.col(reply)))
    p = p.withColumn("__p", F.from_json(F.col("__j"), PROPOSAL))
    acts = F.coalesce(F.col("__p.actions"), F.array())
    typed = F.transform(acts, lambda a: F.struct(F.coalesce(a["type"], F.lit("COMMAND")).alias("type"),
                                                 F.coalesce(a["command"], F.lit("")).alias("command"),
                                                 F.coalesce(a["arguments"], F.array().cast("array<string>"))
                                                 .alias("arguments"),
                                                 F.coalesce(a["context"], F.lit(".")).alias("context")))
    # a missing type has a default, an explicit null is no known type
    raw = F.coalesce(F.from_json(F.col("__j"), "actions array<map<string,string>>")["actions"], F.array())
    valid = F.col("__j").isNotNull() & F.col("__p").isNotNull() & _all(
        typed, lambda a: a["type"].isin(*ACTION_TYPES)) & ~F.exists(
        raw, lambda a: F.coalesce(F.map_contains_key(a, "type") & a["type"].isNull(), F.lit(False)))
    return p.select(key, valid.alias("accepted"),
                    *[F.when(valid, F.coalesce(F.col(f"__p.plan.{k}"), F.lit(v))).alias(k)
                      for k, v in PLAN_DEFAULTS.items()],
                    F.when(valid, typed).alias("actions"),
                    F.when(valid, F.coalesce(F.col("__p.confidence_score"), F.lit(0.0))).alias("confidence_score"))


def recommendation_to_actions(recs: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Actions of the top recommendation.  Commands get FILE_EDIT for a
    local file/config implementation, RUNTIME_OP for a runtime fix, else
    COMMAND; each file edit is XML_EDIT for an XML fix or selector, else
    FILE_EDIT.  No recommendation -> no rows."""
    top = F.try_element_at(F.col("recommendations"), F.lit(1))
    # no filter on the derived list: a predicate on it would be pushed below the
    # parse and re-run it; an empty list simply explodes to no rows
    r = recs.withColumn("__t", top)
    impl = F.col("__t.implementation")
    cmd_type = (F.when(impl["type"].isin("local_file_edit", "local_config"), F.lit("FILE_EDIT"))
                .when(F.col("__t.fix_type") == "runtime_remediation", F.lit("RUNTIME_OP"))
                .otherwise(F.lit("COMMAND")))
    cmds = F.transform(F.coalesce(impl["commands"], F.array().cast("array<string>")),
                       lambda c: F.struct(cmd_type.alias("type"), c.alias("command"),
                                          *[F.lit(None).cast("string").alias(n) for n in FILE_EDIT.names]))
    edits = F.transform(F.coalesce(impl["file_edits"], F.array().cast(_arr(FILE_EDIT))), lambda e: F.struct(
        F.when((F.col("__t.fix_type") == "xml_block_edit") | (F.coalesce(e["xml_selector"], F.lit("")) != ""),
               F.lit("XML_EDIT")).otherwise(F.lit("FILE_EDIT")).alias("type"),
        F.concat(F.lit("Edit "), e["file_path"]).alias("command"), *[e[n].alias(n) for n in FILE_EDIT.names]))
    acts = F.when(impl.isNull(), F.array().cast(_arr(T.StructType([T.StructField("type", S), T.StructField("command", S),
                                                                   *FILE_EDIT.fields])))).otherwise(F.concat(cmds, edits))
    return r.select(key, F.posexplode(acts).alias("pos", "a")).select(
        key, F.col("pos").cast("long").alias("pos"), "a.*")


def validate_recommendations(recs: DataFrame, key: str = "bundle_id") -> DataFrame:
    """List of issues per recommendation row."""
    cause = F.col("primary_cause")
    issues = F.array_compact(F.array(
        F.when(cause.isNull() | (cause == "") | (cause == "unknown"), F.lit(ISSUE_UNKNOWN_CAUSE)),
        F.when(F.coalesce(F.size("recommendations"), F.lit(0)) <= 0, F.lit(ISSUE_NO_RECS)),
        F.when(F.col("final_confidence") == 0.0, F.lit(ISSUE_ZERO_CONF)),
        F.when(F.col("auto_heal_candidate") & (F.col("final_confidence") < LOW_AUTO_HEAL), F.lit(ISSUE_AUTO_HEAL))))
    return recs.select(key, issues.alias("issues"))


def _case_ids() -> Column:
    return F.array_distinct(F.flatten(F.transform(
        F.coalesce(F.col("recommendations"), F.array().cast(_arr(RECOMMENDATION))),
        lambda r: F.transform(F.coalesce(r["similar_cases"], F.array().cast(_arr(SIMILAR_CASE))),
                              lambda s: s["incident_id"]))))


def similar_case_ids(recs: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Distinct similar-case ids across all recommendations, first seen first."""
    return recs.select(key, _case_ids().alias("similar_cases"))


def _severity(raw: Column) -> Column:
    expr = None
    for k, v in SEVERITY_MAP:
        expr = F.when(raw == k, F.lit(v)) if expr is None else expr.when(raw == k, F.lit(v))
    return expr.otherwise(F.lit("high"))


def to_incident_response(recs: DataFrame, bundles: DataFrame | None = None, key: str = "bundle_id",
                         bundle: str | None = None) -> DataFrame:
    """Recommendation (+ bundle) -> the response: fixes with their edits and
    commands, status, approval, diagnosis and meta.  ``bundles`` has the column
    ``bundle`` (default ``key``), affected_services and changed_files."""
    no_texts = F.array().cast(_NO_TEXTS)

    def lowered(x: Column) -> Column:
        return F.when(F.coalesce(x, F.lit("")) != "", F.lower(x)).otherwise(F.lit("unknown"))

    fixes = F.transform(F.coalesce(F.col("recommendations"), F.array().cast(_arr(RECOMMENDATION))), lambda r: F.struct(
        F.concat(F.lit("fix_"), F.when(F.length(r["rank"].cast("string")) < 3, F.lpad(r["rank"].cast("string"), 3, "0"))
                 .otherwise(r["rank"].cast("string"))).alias("fix_id"),
        r["rank"].alias("rank"), r["title"].alias("title"), r["description"].alias("description"),
        lowered(r["risk_level"]).alias("risk"), lowered(r["estimated_effort"]).alias("effort"),
        F.coalesce(F.transform(r["implementation"]["file_edits"], lambda e: F.struct(
            e["file_path"].alias("file"), e["original_context"].alias("find"), e["replacement_text"].alias("replace"))),
            F.array().cast("array<struct<file:string,find:string,replace:string>>")).alias("file_edits"),
        F.coalesce(r["implementation"]["commands"], no_texts).alias("commands"),
        F.coalesce(r["implementation"]["post_checks"], no_texts).alias("verify"),
        F.try_element_at(r["rollback"]["commands"], F.lit(1)).alias("rollback")))
    conf = F.col("final_confidence")
    r = recs.withColumn("fixes", fixes)
    n_fix = F.size("fixes")
    executable = F.exists("fixes", lambda f: (F.size(f["file_edits"]) > 0) | (F.size(f["commands"]) > 0))
    review = F.col("requires_human_review")
    status = (F.when(conf == 0.0, F.lit("analysis_failed")).when(n_fix == 0, F.lit("manual_review"))
              .when(~executable, F.lit("guidance_only"))
              .when(review | (conf < AUTO_APPLY_THRESHOLD), F.lit("pending_approval")).otherwise(F.lit("fix_available")))
    approval = review | (conf < AUTO_APPLY_THRESHOLD) | F.exists("fixes", lambda f: f["risk"].isin(*HIGH_RISK_LEVELS))
    raw = F.when(F.coalesce(F.col("risk_level"), F.lit("")) != "", F.lower("risk_level")).when(
        n_fix > 0, F.lower(F.coalesce(F.try_element_at("recommendations", F.lit(1))["risk_level"], F.lit("unknown")))) \
        .otherwise(F.lit("unknown"))
    used = F.coalesce(F.try_variant_get("metadata", "$.rag_incidents_used", "bigint"), F.lit(0))
    time = F.when(F.col("processing_time_ms") != 0, F.round("processing_time_ms", 1))
    out = r.select(key, *([bundle] if bundle and bundle != key else []), "analyzed_at", time.alias("processing_time_ms"),
                   status.alias("status"), approval.alias("approval_required"),
                   F.coalesce("summary", F.lit("")).alias("summary"), _severity(raw).alias("severity"),
                   F.round(conf, 3).alias("confidence"), F.coalesce(F.col("primary_cause"), F.lit("Unknown")).alias("root_cause"),
                   F.col("timeline").alias("causal_chain"), "fixes", F.lit(False).alias("auto_applied"),
                   used.alias("rag_incidents_used"), _case_ids().alias("similar_cases"))
    if bundles is not None:
        on = bundle or key
        out = out.join(bundles.select(on, "affected_services", "changed_files"), on, "left").withColumns({
            "affected_services": F.coalesce("affected_services", no_texts),
            "affected_files": F.coalesce("changed_files", no_texts)}).drop("changed_files")
    return out


def run_metrics(calls: DataFrame, group: tuple[str, ...] = (), model: str = "model_used",
                latency: str = "latency_ms") -> DataFrame:
    """Requests, successes (model != 'degraded'), degraded, mean latency
    of all calls with a latency, success rate = ok / max(total, 1)."""
    ok = F.col(model) != "degraded"
    g = calls.groupBy(*group).agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(ok).alias("successful"),
                                  F.count_if(~ok).alias("degraded"), F.avg(latency).alias("avg_latency_ms"))
    return g.withColumn("success_rate", F.col("successful") / F.greatest(F.col("total_requests"), F.lit(1)))


def running_latency(calls: DataFrame, keys: tuple[str, ...] = ("service",), order: str = "seq",
                    latency: str = "latency_ms", bucket_width: int = 1 << 14, exact: bool = False) -> DataFrame:
    """Running mean latency per key in ``order`` (an increasing number),
    through the bucketed prefix scan (a hot key is not one task).  ``exact``
    sums an integral latency column as BIGINT (order-independent result)."""
    d = running_sum(calls, list(keys), [order], F.col(latency), "__s", numeric_bucket(order, bucket_width),
                    as_long=exact)
    d = running_sum(d, list(keys), [order], F.lit(1), "__n", numeric_bucket(order, bucket_width))
    return d.withColumn("running_avg_latency_ms", F.col("__s") / F.col("__n")).drop("__s", "__n")

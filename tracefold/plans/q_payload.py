"""Registered queries: the prompt payload (P11) and its fields, read back from the JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators import bundle as B
from tracefold.operators import correlate as C
from tracefold.operators import depgraph as G
from tracefold.operators import patterns as A
from tracefold.operators import payload as P
from tracefold.operators import similar as S
from tracefold.operators.parse import STACK_FILE_RE
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.materialize import materialize
from tracefold.plans.q_extra import _P10, _repo_sql, commits, repo_lines
from tracefold.plans.registry import register

SIMILAR = 3

_PATTERN = "struct<pattern:string,count:long,severity:string,affectedService:string,firstOccurrence:string>"
_CLUSTER = ("struct<timestamp:string,rootCauses:array<struct<rank:long,pattern:string,severity:string,"
            f"affectedService:string,reason:string>>,effects:array<{_PATTERN}>>")
PAYLOAD = ("id string, window struct<start:string,end:string>, rootService string, affectedServices array<string>, "
           f"errorCorrelation struct<primaryCluster:{_CLUSTER},secondaryClusters:array<{_CLUSTER}>>, "
           "events array<struct<type:string,reason:string,service:string,pod:string>>, "
           "metrics struct<cpuZ:double,memZ:double,latencyZ:double,errorRateZ:double>, dependencyGraph array<string>, "
           "sequence array<struct<timestamp:string,type:string,message:string,idx:long>>, derivedRootCauseHint string, "
           "triggerReason string, gitContext struct<repo:string,branch:string,recentCommits:array<string>,"
           "userConfig:struct<name:string>>, codeSnippets array<struct<file:string,lines:string,content:string>>, "
           "similarIncidents array<struct<id:string,summary:string,rootCause:string,similarityScore:double>>")


def similar_bundles(spark, sf_dir) -> DataFrame:
    """P9 -> G3 -> J7: the bundles whose summaries' embeddings are closest, itself excluded."""
    emb = materialize(S.hash_embedding(FL.summaries_b(spark, sf_dir), "summary"), "embedded")
    hint = A.derive_hint(FL.patterns_b(spark, sf_dir), level="error_class", ord_col="first_entry_no")
    near = S.top_k_similar(emb.withColumnRenamed("bundle_id", "query_id"), emb.withColumnRenamed("bundle_id", "index_id"),
                           k=SIMILAR, exclude_self=True)
    about = emb.select(F.col("bundle_id").alias("id"), "summary").join(
        hint.select(F.col("bundle_id").alias("id"), F.col("hint").alias("root_cause")), "id", "left")
    return near.select(F.col("query_id").alias("bundle_id"), F.col("index_id").alias("id"), "similarity", "rank").join(about, "id")


def payloads(spark, sf_dir, similar: bool = False) -> DataFrame:
    pats, _, _, nodes = FL.graph_b(spark, sf_dir)
    scored = C.match_dependencies(pats, C.dependency_priority(nodes))
    cl = materialize(C.cluster_by_gap(scored, gap_seconds=FL.FIXTURE_GAP_SECONDS), "clusters")
    causes = materialize(C.rank_root_causes(cl), "causes")
    correlated = P.correlation(cl, causes, C.rank_clusters(cl, causes), C.effects(cl, causes))
    ev = FL.events_b(spark, sf_dir)
    group = lambda n: F.regexp_extract_all("pattern", F.lit(STACK_FILE_RE), n)
    frames = pats.select("bundle_id", "pattern_ord", F.posexplode(F.arrays_zip(group(3).alias("f"), group(4).alias("l")))
                         .alias("pos", "x")).select(
        "bundle_id", F.struct("pattern_ord", "pos").alias("ord"), F.col("x.f").alias("src_file"),
        F.col("x.l").cast("int").alias("src_line"))
    win = A.bundle_window(pats)
    cited = frames.select("bundle_id", F.col("src_file").alias("file")).distinct().join(
        win.select("bundle_id", F.col("window_start").alias("incident_ts")), "bundle_id")
    made = B.recent_commit(cited, commits(spark, sf_dir)).where("commit_hash is not null").select(
        "bundle_id", "commit_hash", "commit_ts", "message", "author",
        F.concat(F.lit("repo/"), F.substring_index("bundle_id", "/", 1)).alias("repo"), F.lit("main").alias("branch"))
    trigger = pats.groupBy("bundle_id").agg(F.when(F.max(F.col("error_class") == "ERROR"), "error_detected")
                                            .otherwise("time_window_expired").alias("trigger_reason"))
    return P.prompt_payload(
        win, correlated, ev, B.sequence_index(pats, ev), FL.metrics_b(spark, sf_dir), nodes,
        A.derive_hint(pats, level="error_class", ord_col="first_entry_no").select("bundle_id", "hint"),
        G.root_service(nodes).select("bundle_id", "root_service"),
        A.affected_services(pats).select("bundle_id", "affected_services"), trigger=trigger, commits=made,
        snippets=B.attach_snippets(frames, repo_lines(spark, sf_dir)),
        similar=similar_bundles(spark, sf_dir) if similar else None)


def _parsed(spark, sf_dir) -> DataFrame:
    p = materialize(payloads(spark, sf_dir), "payloads")
    return p.select("bundle_id", F.from_json("payload", PAYLOAD).alias("d"))


@register("P11_prompt_payload")
def q_prompt_payload(spark, sf_dir):
    """P11 with retrieval: P9, G3 and J7 give the similar incidents (no SQL: G3 is built on sha512)."""
    return payloads(spark, sf_dir, similar=True)


_CTES = _P10.rpartition("\nSELECT w.bundle_id")[0]


@register("P11_payload_fields", _CTES + f""",
trig AS (SELECT bundle_id, CASE WHEN bool_or(error_class = 'ERROR') THEN 'error_detected' ELSE 'time_window_expired' END
  AS trigger_reason FROM patterns_b GROUP BY bundle_id)
SELECT w.bundle_id, {O.iso_s('w.window_start')} AS window_start, {O.iso_s('w.window_end')} AS window_end, root_service,
  array_to_string(coalesce(affected_services, []), ',') AS affected_services,
  array_to_string(coalesce(chain, []), ',') AS graph, hint, trigger_reason, round(cpu_z, 6) AS cpu_z,
  round(mem_z, 6) AS mem_z, round(latency_z, 6) AS latency_z, round(error_rate_z, 6) AS error_rate_z
FROM win w LEFT JOIN root USING (bundle_id) LEFT JOIN aff USING (bundle_id) LEFT JOIN chain USING (bundle_id)
  LEFT JOIN hint USING (bundle_id) LEFT JOIN trig USING (bundle_id) LEFT JOIN metrics USING (bundle_id)""")
def q_payload_fields(spark, sf_dir):
    """The plain fields of every payload."""
    z = [F.round(f"d.metrics.{c}", 6).alias(n) for c, n in (("cpuZ", "cpu_z"), ("memZ", "mem_z"), ("latencyZ", "latency_z"),
                                                           ("errorRateZ", "error_rate_z"))]
    return _parsed(spark, sf_dir).select(
        "bundle_id", F.col("d.window.start").alias("window_start"), F.col("d.window.end").alias("window_end"),
        F.col("d.rootService").alias("root_service"), F.array_join("d.affectedServices", ",").alias("affected_services"),
        F.array_join("d.dependencyGraph", ",").alias("graph"), F.col("d.derivedRootCauseHint").alias("hint"),
        F.col("d.triggerReason").alias("trigger_reason"), *z)


@register("P11_payload_causes", "WITH " + O.causes_ctes(FL.FIXTURE_GAP_SECONDS, dep_cte=O.graph_ctes()) + f""",
crank AS (SELECT bundle_id, cluster_no, row_number() OVER (PARTITION BY bundle_id ORDER BY coalesce(s, 0) DESC, cluster_no)
    - 1 AS cluster
  FROM (SELECT DISTINCT bundle_id, cluster_no FROM clustered) LEFT JOIN (SELECT bundle_id, cluster_no, severity_score AS s
    FROM causes WHERE rank = 1) USING (bundle_id, cluster_no)),
eff AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, cluster_no ORDER BY first_ts ASC NULLS FIRST, first_entry_no)
    AS pos FROM clustered c WHERE NOT EXISTS (SELECT 1 FROM causes r WHERE r.bundle_id = c.bundle_id
    AND r.cluster_no = c.cluster_no AND r.pattern = c.pattern))
SELECT bundle_id, cluster, 'cause' AS kind, CAST(rank AS BIGINT) AS pos, substr(pattern, 1, 3000) AS pattern,
  error_class AS severity, {O.clean_service_sql('container')} AS service, reason FROM causes
  JOIN crank USING (bundle_id, cluster_no) WHERE cluster < 4
UNION ALL SELECT bundle_id, cluster, 'effect', pos, substr(pattern, 1, 3000), error_class,
  {O.clean_service_sql('container')}, CAST(count AS VARCHAR) || 'x since ' || {O.iso_s('first_ts')} FROM eff
  JOIN crank USING (bundle_id, cluster_no) WHERE cluster < 4 AND pos <= 5""")
def q_payload_causes(spark, sf_dir):
    """Ranked causes and effects of the primary (0) and the secondary clusters."""
    every = F.concat(F.array("d.errorCorrelation.primaryCluster"), F.col("d.errorCorrelation.secondaryClusters"))
    c = _parsed(spark, sf_dir).select("bundle_id", F.posexplode(every).alias("cluster", "c"))
    cause = F.transform("c.rootCauses", lambda r: F.struct(
        F.lit("cause").alias("kind"), r["rank"].alias("pos"), r["pattern"].alias("pattern"), r["severity"].alias("severity"),
        r["affectedService"].alias("service"), r["reason"].alias("reason")))
    effect = F.transform("c.effects", lambda e, i: F.struct(
        F.lit("effect").alias("kind"), (i + 1).cast("long").alias("pos"), e["pattern"].alias("pattern"),
        e["severity"].alias("severity"), e["affectedService"].alias("service"),
        F.concat(e["count"].cast("string"), F.lit("x since "), e["firstOccurrence"]).alias("reason")))
    return c.select("bundle_id", F.col("cluster").cast("long").alias("cluster"),
                    F.explode(F.concat(cause, effect)).alias("x")).select("bundle_id", "cluster", "x.*")


@register("P11_payload_context", _CTES + _repo_sql() + f""",
seq AS (SELECT bundle_id, first_ts AS ts, 'log' AS type, pattern_key AS item_id,
    '[' || {O.clean_service_sql('container')} || '] ' || pattern AS message FROM patterns_b
  UNION ALL SELECT bundle_id, ts, 'event', id, reason FROM ev_b),
sq AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ts ASC NULLS FIRST, type, item_id) AS n FROM seq),
sf0 AS (SELECT bundle_id, pattern_ord, regexp_extract_all(pattern, '{STACK_FILE_RE}', 3) AS f,
  regexp_extract_all(pattern, '{STACK_FILE_RE}', 4) AS l FROM patterns_b),
sf1 AS (SELECT bundle_id, pattern_ord, generate_subscripts(f, 1) AS pos, unnest(f) AS src_file, unnest(l) AS src_line FROM sf0),
fr AS (SELECT bundle_id, src_file, arg_min(CAST(src_line AS INTEGER), struct_pack(a := pattern_ord, b := pos)) AS src_line,
  min(struct_pack(a := pattern_ord, b := pos)) AS ord FROM sf1 GROUP BY bundle_id, src_file),
gc AS (SELECT md5(CAST(event_id AS VARCHAR)) AS h, ts, event_id, unnest(CASE CAST(event_id % 3 AS INTEGER)
    WHEN 0 THEN ['Main.java'] WHEN 1 THEN ['HikariPool.java'] ELSE ['Main.java', 'HikariPool.java'] END) AS file FROM events),
gj AS (SELECT fr.bundle_id, fr.src_file, arg_max(struct_pack(h := gc.h, ts := gc.ts, e := gc.event_id),
    struct_pack(t := gc.ts, h := gc.h)) AS c
  FROM fr JOIN win USING (bundle_id) JOIN gc ON gc.file = fr.src_file AND gc.ts <= window_start GROUP BY ALL),
gd AS (SELECT DISTINCT bundle_id, c.h AS h, c.ts AS ts, c.e AS e FROM gj),
gr AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ts DESC, h) AS n FROM gd),
files AS (SELECT string_split(file_path, '/')[-1] AS base, min(file_path) AS file_path
  FROM (SELECT DISTINCT file_path FROM repo) GROUP BY base),
hit AS (SELECT fr.*, files.file_path FROM fr JOIN files ON fr.src_file = files.base),
snip AS (SELECT h.bundle_id, h.file_path, h.src_line, h.ord, string_agg(r.text || chr(10), '' ORDER BY r.line_no) AS content
  FROM hit h JOIN repo r ON r.file_path = h.file_path AND r.line_no BETWEEN h.src_line - 10 AND h.src_line + 10
  GROUP BY h.bundle_id, h.file_path, h.src_line, h.ord),
sn AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ord) AS n FROM snip)
SELECT bundle_id, 'event' AS kind, CAST(r AS BIGINT) AS pos, type || '|' || reason || '|' || service || '|' || pod AS value
  FROM ev5 WHERE r <= 10
UNION ALL SELECT bundle_id, 'sequence', n, type || '|' || coalesce({O.iso_s('ts')}, '') || '|' || substr(message, 1, 200)
  FROM sq WHERE n <= 50
UNION ALL SELECT bundle_id, 'commit', n, substr(h, 1, 8) || ' change ' || CAST(e AS VARCHAR) FROM gr WHERE n <= 5
UNION ALL SELECT bundle_id, 'repo', 1, 'repo/' || split_part(bundle_id, '/', 1) || '@main by user' || CAST(user_id AS VARCHAR)
  FROM gr JOIN events ON event_id = e WHERE n = 1
UNION ALL SELECT bundle_id, 'snippet', n, file_path || ':' || CAST(greatest(1, src_line - 5) AS VARCHAR) || '-'
  || CAST(src_line + 10 AS VARCHAR) || chr(10) || content FROM sn WHERE n <= 5""")
def q_payload_context(spark, sf_dir):
    """Events, sequence, commits and snippets of every payload."""
    def rows(kind, items, value):
        return F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("long").alias("pos"),
                                                        value(x).alias("value")))
    bar = F.lit("|")
    git = F.concat("d.gitContext.repo", F.lit("@"), "d.gitContext.branch", F.lit(" by "), "d.gitContext.userConfig.name")
    lists = [
        rows("event", "d.events", lambda x: F.concat(x["type"], bar, x["reason"], bar, x["service"], bar, x["pod"])),
        rows("sequence", "d.sequence", lambda x: F.concat(x["type"], bar, F.coalesce(x["timestamp"], F.lit("")), bar, x["message"])),
        rows("commit", "d.gitContext.recentCommits", lambda x: x),
        rows("repo", F.array_compact(F.array(git)), lambda x: x),
        rows("snippet", "d.codeSnippets", lambda x: F.concat(x["file"], F.lit(":"), x["lines"], F.lit("\n"), x["content"]))]
    empty = F.array().cast("array<struct<kind:string,pos:bigint,value:string>>")
    return _parsed(spark, sf_dir).select("bundle_id", F.explode(F.concat(*[F.coalesce(x, empty) for x in lists])).alias("x")).select(
        "bundle_id", "x.*")

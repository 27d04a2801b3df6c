"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import (chat, html_extract, lexical, license_scan, minhash, mixing, packing, quality, quality_model,
                           resample, sharding, suffix, topk)
from tracefold.llm.common import load

#: Byte-level BPE vocabulary file that packing uses.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))


def _rules_sql(rules=quality.RULES) -> str:
    parts = []
    for r in rules:
        if r.low is not None:
            parts.append(f"{r.numerator} >= {r.denominator} * {r.low}::DOUBLE")
        if r.high is not None:
            parts.append(f"{r.numerator} <= {r.denominator} * {r.high}::DOUBLE")
    return " AND ".join(parts)


def quality_sql(source: str = "documents") -> str:
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\x09-\\x0D]')) AS ls
  FROM {source}),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {quality.WINDOW - 1}), ' ') AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {quality.WINDOW - 1})) AS i
        FROM base WHERE len(w) >= {quality.WINDOW})),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n >= 2),
cov AS (
  SELECT doc_id, sum(least({quality.WINDOW}, gap)) AS n FROM (
    SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {quality.WINDOW}) AS gap FROM rep)
  GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: rtrim(lower(x), '.,;:') IN ({_stop_list()})))::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_lines
  FROM base b LEFT JOIN cov c USING (doc_id)),
f AS (SELECT *, (n_words < {quality.MIN_WORDS}
                 OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {_rules_sql()}) AS kept, n_stop_words, n_lines
FROM f"""


@register("op9_quality_rules", quality_sql())
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality.quality_report(load(spark, sf_dir, "documents"))
    return r.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


SHARDING_SQL = f"""
WITH r AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS h,
         coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
lv AS (SELECT doc_id, h, n_bytes, d, h >> ({sharding.BITS} - d) AS prefix
       FROM r, (SELECT unnest(generate_series(0, {sharding.BITS})) AS d)),
b AS (SELECT d, prefix FROM lv GROUP BY d, prefix HAVING sum(n_bytes) <= {sharding.SHARD_BYTES}),
f AS (SELECT doc_id, any_value(n_bytes) AS n_bytes, any_value(h) AS h, min(d) AS depth
      FROM lv JOIN b USING (d, prefix) GROUP BY doc_id)
SELECT doc_id, n_bytes, depth::BIGINT AS depth, (h >> ({sharding.BITS} - depth))::BIGINT AS prefix, 0::BIGINT AS page,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({sharding.BITS} - depth)), depth::INT, '0') END AS shard,
       n_bytes > {sharding.SHARD_BYTES} AS oversized
FROM f"""


@register("op4_sharding", SHARDING_SQL)
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"))


def mixing_sql(source: str = "documents") -> str:
    lists = mixing.lexicon(mixing.TOPICS)
    known = ", ".join(f"'{w}'" for w in sorted({w for ws in lists.values() for w in ws}))
    counts = ", ".join("len(list_filter(k, lambda x: x IN ({}))) AS n_{}".format(", ".join(f"'{w}'" for w in ws), t)
                       for t, ws in lists.items())
    top = "greatest({})".format(", ".join(f"n_{t}" for t in lists))
    topic = " ".join(f"WHEN n_{t} = {top} THEN '{t}'" for t in lists)
    shares = " UNION ALL ".join(
        f"SELECT '{d}' AS dim, {d} AS value, sum(tokens) AS tokens, pow(sum(tokens)::DOUBLE, {p}) / (SELECT sum(x) FROM "
        f"(SELECT pow(sum(tokens)::DOUBLE, {p}) AS x FROM c GROUP BY {d})) AS share FROM c GROUP BY {d}"
        for d, p in mixing.FLATTEN.items())
    steps, last = [], "k0"
    for n in range(1, mixing.SWEEPS + 1):
        for dim in mixing.DIMS:
            name = f"k{n}_{dim}"
            steps.append(
                f"{name}_f AS (SELECT *, (goal_{dim} - coalesce(sum(tokens) OVER (PARTITION BY {dim} ORDER BY u DESC, source, lang, topic "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(tokens * u) OVER (PARTITION BY {dim} ORDER BY u DESC, "
                f"source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM {last}), "
                f"{name} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE (u * coalesce(max(CASE WHEN f * u <= 1 THEN f END) "
                f"OVER (PARTITION BY {dim}), 1 / min(u) OVER (PARTITION BY {dim})) AS u) FROM {name}_f)")
            last = name
    return f"""
WITH b AS (
  SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
         length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n_lines,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[ \x09-\x0D]+'), lambda x: x <> '') AS w
  FROM {source}),
q AS (SELECT *, list_filter(w, lambda x: x IN ({known})) AS k FROM b),
t AS (SELECT *, {counts} FROM q),
f AS MATERIALIZED (
  SELECT doc_id, source, lang, len(w)::BIGINT AS tokens,
         CASE WHEN {top} = 0 THEN CASE WHEN len(w) = 0 THEN 'none'
              WHEN len(list_filter(w, lambda x: x = '|')) * {mixing.TABLE_BARS} >= len(w) THEN 'table'
              WHEN n_lines * {mixing.LINE_WORDS} >= len(w) THEN 'lines' ELSE 'prose' END {topic} END AS topic FROM t),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM f GROUP BY ALL HAVING sum(tokens) > 0),
g AS MATERIALIZED (SELECT *, share * {mixing.KEEP_SHARE} * min(tokens / share) OVER () AS goal FROM ({shares})),
k0 AS MATERIALIZED (
  SELECT c.*, 1::DOUBLE AS u, gs.goal AS goal_source, gl.goal AS goal_lang, gt.goal AS goal_topic FROM c
  JOIN g gs ON gs.dim = 'source' AND gs.value = source JOIN g gl ON gl.dim = 'lang' AND gl.value = lang
  JOIN g gt ON gt.dim = 'topic' AND gt.value = topic),
{", ".join(steps)},
o AS (SELECT f.*, CASE WHEN f.tokens = 0 THEN 1.0 ELSE least(1.0, r.u) END AS p
      FROM f LEFT JOIN {last} r USING (source, lang, topic))
SELECT doc_id, source, lang, topic, tokens, round(p, 4) AS p,
       ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(1 << 52)}
         < p AS kept
FROM o"""


@register("op5_mixing", mixing_sql())
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("p", 4).alias("p"), "kept")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(load(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


NEAR_DEDUP_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a),
g AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN g USING (doc_id)"""


@register("op2_minhash_near_dedup", NEAR_DEDUP_SQL)
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), width=2, percent=80)


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(load(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@register("op6_exact_top_k", TOP_K_SQL)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k_embeddings(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return out.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"),
                      "score")


@register("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


CHAT_SQL = """
WITH RECURSIVE c AS MATERIALIZED (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
s AS MATERIALIZED (
  SELECT *, chr(1) || array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))), lambda x: x <> ''), chr(1)) || chr(1) AS lines
  FROM c),
m AS (
  SELECT s.*, CASE WHEN turn > 0 AND turn % 5 <> 3 THEN CASE WHEN turn % 4 = 0 THEN turn - 2 ELSE turn - 1 END END AS to1
  FROM s),
g AS (
  SELECT m.conv_id, m.turn, a.turn AS t1, a.lines AS l1, b.turn AS t2, b.lines AS l2 FROM m
  LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.to1
  LEFT JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.to1),
q AS (SELECT conv_id, turn, 1 AS level, l1 AS lines FROM g WHERE t1 IS NOT NULL
      UNION ALL SELECT conv_id, turn, 2, l2 FROM g WHERE t2 IS NOT NULL),
b AS (
  SELECT q.conv_id, q.turn, level, max(s.turn) AS origin FROM q JOIN s ON s.conv_id = q.conv_id AND s.turn < q.turn
  AND length(q.lines) > 2 AND contains(s.lines, q.lines) GROUP BY q.conv_id, q.turn, level),
p AS (
  SELECT g.conv_id, g.turn, (t1 IS NOT NULL)::BIGINT + (t2 IS NOT NULL)::BIGINT AS n_passages,
         (SELECT count(*) FROM b WHERE b.conv_id = g.conv_id AND b.turn = g.turn) AS n_linked,
         coalesce((SELECT first(origin ORDER BY level) FROM b WHERE b.conv_id = g.conv_id AND b.turn = g.turn),
                  (SELECT max(turn) FROM c WHERE c.conv_id = g.conv_id AND c.turn < g.turn)) AS parent FROM g),
r AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM p WHERE parent IS NULL
  UNION ALL SELECT p.conv_id, p.turn, r.root, r.depth + 1 FROM r JOIN p ON p.conv_id = r.conv_id AND p.parent = r.turn)
SELECT conv_id, turn, c.role, p.parent AS parent_turn, r.root AS root_turn, r.depth::BIGINT AS depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY r.depth, turn) - 1 AS position, n_passages, n_linked,
       trim(c.text, ' ' || chr(10)) AS text, '<|' || c.role || '|>' || chr(10) || trim(c.text, ' ' || chr(10)) AS formatted
FROM c JOIN p USING (conv_id, turn) JOIN r USING (conv_id, turn)"""


@register("op1_chat_formatting", CHAT_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(chat.as_mail(load(spark, sf_dir, "conversations")))


def license_sql(templates: dict[str, str] = license_scan.TEMPLATES, source: str = "documents") -> str:
    """Shingles of min(5, words of the template) words; windows of twice the power of two that a template fits in."""
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''"))
                     for k, v in sorted(templates.items()))
    split = ("list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')")
    return f"""
WITH t AS (SELECT template, {split.format('body')} AS w FROM (VALUES {rows}) v(template, body)),
ts AS (SELECT template, least(len(w), {license_scan.WIDTH}) AS width, unnest(range(1, len(w) - width + 2)) AS i, w
       FROM t WHERE len(w) > 0),
th AS MATERIALIZED (SELECT template, width, count(*) OVER (PARTITION BY template) AS span,
                    array_to_string(w[i:i + width - 1], ' ') AS x FROM ts),
n AS (SELECT template, width, count(DISTINCT x) AS size, pow(2, ceil(log2(any_value(span))))::BIGINT AS step
      FROM th GROUP BY template, width),
d AS (SELECT doc_id, {split.format('text')} AS w FROM {source}),
ds AS MATERIALIZED (
  SELECT doc_id, width, unnest(range(0, len(xs))) AS pos, unnest(xs) AS x
  FROM (SELECT doc_id, width, list_transform(range(1, len(w) - width + 2),
                                             lambda i: array_to_string(w[i:i + width - 1], ' ')) AS xs
        FROM d, (SELECT DISTINCT width FROM n) WHERE len(w) >= width)),
hits AS (SELECT doc_id, template, x, pos FROM ds JOIN (SELECT DISTINCT template, width, x FROM th) USING (width, x)),
wins AS (SELECT doc_id, template, x, pos, pos // step AS k FROM hits JOIN n USING (template)
         UNION ALL SELECT doc_id, template, x, pos, pos // step - 1 FROM hits JOIN n USING (template) WHERE pos >= step),
f AS (SELECT doc_id, template, k, count(DISTINCT x) / any_value(size)::DOUBLE AS share, min(pos) AS word
      FROM wins JOIN n USING (template) GROUP BY doc_id, template, k)
SELECT doc_id, template, round(max(share), 6) AS containment, count(*) AS n_windows, min(word) AS first_word
FROM f WHERE share >= {license_scan.CONTAINMENT} GROUP BY doc_id, template"""


@register("op10_license_scan", license_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))


#: crc32 of each distinct word ``w``, as SQL over a table ``voc(w)``.
CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256))::BIGINT AS i))),
crcs AS MATERIALIZED (
  SELECT w, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, strlen(w)),
    lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]))) AS crc FROM voc, crc_table)"""

BYTE_WORDS_SQL = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                  "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

RESAMPLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {BYTE_WORDS_SQL.format('text')} AS ws FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS MATERIALIZED (SELECT unnest({BYTE_WORDS_SQL.format('text')}) AS w FROM benchmark),
voc AS (SELECT w FROM dw UNION SELECT w FROM bw),
{CRC_SQL},
b AS MATERIALIZED (SELECT w, crc % {resample.BUCKETS} AS bucket FROM crcs),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw) + {resample.BUCKETS} AS ns, (SELECT count(*) FROM bw) + {resample.BUCKETS} AS nt),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ns / ((coalesce(s, 0) + 1)::DOUBLE * nt)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), n),
e AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN e USING (doc_id)),
o AS (SELECT doc_id, n_features, weight,
             weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM o
      WHERE n_features >= {resample.MIN_WORDS})
SELECT o.*, CASE WHEN rank <= {resample.SHARE[0]} * n // {resample.SHARE[1]} THEN rank END AS rank
FROM o LEFT JOIN r USING (doc_id)"""


@register("op11_importance_resampling", RESAMPLE_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_features", "weight", "score", "rank")


SEARCH_SQL = f"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, unnest({BYTE_WORDS_SQL.format('text')}) AS w FROM documents),
len AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY doc_id),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM len),
tf AS (SELECT doc_id, w, count(*) AS tf FROM dw GROUP BY doc_id, w),
df AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
       FROM tf, size GROUP BY w, docs),
qt AS (SELECT item_id, unnest({BYTE_WORDS_SQL.format('text')}) AS w FROM benchmark),
s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT
         AS score
  FROM qt JOIN tf USING (w) JOIN df USING (w) JOIN len USING (doc_id), size GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= {lexical.TOP}"""


@register("op12_ranked_lexical_search", SEARCH_SQL)
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@register("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

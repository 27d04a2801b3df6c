"""Column expressions for log text: levels, severities, normalisation, names.

All of these are native Spark expressions (regexp_replace / rlike / contains /
CASE), so they stay inside whole-stage codegen.  Patterns are Java regex; the
DuckDB oracle text in ``tracefold.plans.oracle`` spells the same rules in RE2.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------

# Variant A severity keywords, in the reference's priority order.
SEVERITY_KEYWORDS_A = [
    "FATAL", "PANIC", "CRITICAL", "EMERG",
    "ERROR", "EXCEPTION", "FAIL", "CRASH",
    "WARN", "WARNING",
    "INFO", "DEBUG", "TRACE",
]

# Variant A normalisation rules, applied in this order after timestamps are removed.
NORM_A_RULES = [
    (r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "<UUID>"),
    (r"\b[a-f0-9]{7,40}\b", "<HEX>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r":\d{2,5}\b", ":<PORT>"),
    (r"\b(?!404|500|503|200|201|301|302)\d+\b", "<NUM>"),
    (r"0x[a-f0-9]+", "<ADDR>"),
    (r"\[[^\]]*-\d+\]", "[<THREAD>]"),
]

# Variant B normalisation rules (grouping key is md5 of the result).
NORM_B_RULES = [
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"(?i)(?:user_?id|order_?id|request_?id|session_?id|id)[=:]\s*\w+", "id=<ID>"),
    (r"(?<![:\(])\b\d{6,}\b(?!\))", "<NUM>"),
    (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}", "<TS>"),
]

# Variant B level words (word-boundary match on the upper-cased head line).
LEVEL_B_ERROR_RE = r"\b(ERROR|FATAL|CRITICAL|EXCEPTION)\b"
LEVEL_B_WARN_RE = r"\b(WARN|WARNING)\b"

# Pattern severity score keyword sets; three call sites use slightly different sets.
SCORE_SETS = {
    "correlator": (["fatal", "panic", "critical", "emerg"],
                   ["error", "exception", "fail", "crash"],
                   ["warning", "warn"]),
    "prompt": (["fatal", "panic", "critical", "emerg"],
               ["error", "exception", "fail", "crash", "unhandled"],
               ["warning", "warn"]),
    "summary": (["fatal", "panic", "critical"],
                ["error", "exception", "fail"],
                ["warning", "warn"]),
}

# Pod / container suffixes removed to get a service name.
POD_HASH_SUFFIX_RE = r"-[a-f0-9]+-[a-z0-9]+$"
POD_ORDINAL_SUFFIX_RE = r"-\d+$"

# Severities counted as errors by the variant A error rate and hint.
ERROR_SEVERITIES_A = ["ERROR", "FATAL", "EXCEPTION"]

# ---------------------------------------------------------------------------


def _chain(c: Column, rules) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, c)


def norm_b(c: Column) -> Column:
    """Variant B placeholder normalisation (text otherwise untouched)."""
    return _chain(c, NORM_B_RULES)


def pattern_key_b(message: Column) -> Column:
    """Grouping key of variant B: md5 hex of the normalised message."""
    return F.md5(norm_b(message))


def level_b(line: Column) -> Column:
    up = F.upper(line)
    return (F.when(up.rlike(LEVEL_B_ERROR_RE), F.lit("ERROR"))
            .when(up.rlike(LEVEL_B_WARN_RE), F.lit("WARNING"))
            .otherwise(F.lit("INFO")))


def level_rank_b(level: Column) -> Column:
    """Sort rank used by the variant B deduplicator: ERROR, WARNING, INFO, other."""
    return (F.when(level == "ERROR", 0).when(level == "WARNING", 1)
            .when(level == "INFO", 2).otherwise(3))


def severity_a(line: Column) -> Column:
    """Variant A severity: only the first ``[WORD]`` is tested, then a substring
    scan in keyword order (so WARN shadows WARNING and 'failover' is FAIL)."""
    bracket = F.upper(F.regexp_extract(line, r"\[(\w+)\]", 1))
    up = F.upper(line)
    words = list(SEVERITY_KEYWORDS_A)
    by_bracket = reduce(lambda acc, w: acc.when(bracket == w, F.lit(w)),
                        words[1:], F.when(bracket == words[0], F.lit(words[0])))
    by_scan = reduce(lambda acc, w: acc.when(up.contains(w), F.lit(w)),
                     words[1:], F.when(up.contains(words[0]), F.lit(words[0])))
    return F.coalesce(by_bracket, by_scan)


def _contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def severity_score(pattern: Column, severity: Column, keyword_set: str = "correlator") -> Column:
    """100 / 80 / 50 / 10 by keyword presence in lower(pattern + ' ' + severity)."""
    crit, err, warn = SCORE_SETS[keyword_set]
    text = F.lower(F.concat(pattern, F.coalesce(F.concat(F.lit(" "), severity), F.lit(""))))
    return (F.when(_contains_any(text, crit), F.lit(100))
            .when(_contains_any(text, err), F.lit(80))
            .when(_contains_any(text, warn), F.lit(50))
            .otherwise(F.lit(10)))


def norm_a(line: Column) -> Column:
    """Variant A: drop timestamps, apply the 7 rules, collapse whitespace."""
    from tracefold.functions.time import TS_A_PATTERNS
    c = reduce(lambda acc, p: F.regexp_replace(acc, p, ""), TS_A_PATTERNS, line)
    c = _chain(c, NORM_A_RULES)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_service(container: Column) -> Column:
    """k8s pod/container name -> service name."""
    return F.regexp_replace(F.regexp_replace(container, POD_HASH_SUFFIX_RE, ""),
                            POD_ORDINAL_SUFFIX_RE, "")

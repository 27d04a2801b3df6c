"""Quality rules: a threshold table compiled into one Spark projection.

Every metric of a text (counts of words, symbols, repeated lines, repeated
8-word windows, stop words) is a built-in column expression; ``RULES`` is a
table of (ratio, lowest, highest) and ``verdict`` folds it into one boolean
column.  There is no shuffle and no user function: one scan, one projection.

Defined results: a null text counts as empty; a text without words has zero
counts and fails the base rule; rows repeat freely (each is judged alone);
columns of the input never clash, as they travel inside one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import WORD_GAP, computed

#: Fixed values of the base rule.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for on was with as by be at it from or an are this "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en un du une que est pour qui dans par plus pas au sur "
    "el los y del se las por con no una su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a bound of None is open."""
    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.03, None),
    Rule("repeated_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """``struct row`` (the whole input row) and the seven counts.

    Repeated windows: all 8-word windows are hashed; only a text in which two
    hashes agree sorts its (hash, position) list, where equal neighbours are
    compared word by word, so a hash collision counts nothing."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(F.struct("*").alias("row"), t.alias("t"))
    w = F.filter(F.split("t", WORD_GAP), lambda x: x != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select("row", w.alias("w"), lines.alias("lines"),
                       F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"))
    n = F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                              lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))
    base = base.select(
        "row", "w", "n_symbols", windows.alias("h"), n.alias("n_words"),
        F.char_length(F.array_join("w", "")).alias("word_chars"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.rtrim(F.lower(x), F.lit(".,;:")).isin(*dict.fromkeys(STOP_WORDS)))).alias(
            "n_stop_words"))
    order = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform(
        "h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))
    rest = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_stop_words", "n_lines"]
    base = base.select(*rest, "w", order.alias("p"))

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((y["h"] == x["h"]) & (F.slice("w", y["i"], WINDOW) == F.slice("w", x["i"], WINDOW)),
                          F.lit(False))

    twice = F.filter("p", lambda x, j: equal(x, F.get("p", j - 1)) | equal(x, F.get("p", j + 1)))
    base = base.select(*rest, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    return base.select(*rest, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words").cast("long") * 100 > F.col("n_words").cast("long") * MAX_REPEAT_PERCENT)


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression.  Ratios are compared as
    products with the denominator, so an empty text divides nothing."""
    ok = ~base_failed()
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.numerator) >= F.col(r.denominator) * F.lit(r.low))
        if r.high is not None:
            ok = ok & (F.col(r.numerator) <= F.col(r.denominator) * F.lit(r.high))
    return ok


def quality_report(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: ``row`` (struct), the counts, ``base_failed``, ``kept``."""
    m = metrics(df, text)
    return m.select("row", *[F.col(c).cast("long").alias(c) for c in METRICS],
                    base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that pass every rule, with their own columns."""
    return computed(quality_report(df, text, rules).select("row", "kept")).filter("kept").select("row.*")

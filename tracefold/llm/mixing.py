"""Mixing sources to target weights by iterative proportional fitting (raking),
with DataFrame operations only.

Targets are a table (dim, value, share): the shares that the values of source,
language and topic are to have among the tokens of the *sample*.  Documents are
pre-aggregated to one row per (source, lang, topic) cell, and the raking runs over
this table of cells.  A cell of t tokens is drawn with probability p = min(1, u);
a sweep scales u in every source, then language, then topic so that the expected
tokens, the sum of t * min(1, u), meet the target.  The bound 1 is inside the
sweeps: a factor is solved for exactly, cells that reach the bound staying at it.
Sweeps repeat until no marginal is off by more than ``TOLERANCE`` or ``SWEEPS`` are
done.  A document is drawn when its repeatable uniform number lies below its
cell's p.

The size of the sample follows from the targets: no value may need more tokens
than it has, so the expected size is ``KEEP_SHARE`` of min(tokens of v / share of v).
Targets that cannot be met together (and sweeps that did not converge) show in
``report``, which gives target and expected share of every value.

Default targets flatten the corpus' own shares (``FLATTEN``).  Topic: the corpus has
no topic column, so the topic is the one of ``TOPICS`` with most words in the text
(ties: the first of the table), else the register: table, lines or prose.

Defined results: null sources, languages and texts form the value ``'none'``; a
null text has no tokens; documents without tokens carry no weight and are kept
(probability 1); a value without a target is left as large as it is drawn by the
other dimensions; a target without documents is ignored; rows repeating an id
share its draw; very long texts are read whole; columns of the input travel inside
one struct, so none can clash; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import WORD_GAP, computed, uniform, written

#: Default target share of a value: its token share to this power, renormalised.
FLATTEN = {"source": 0.9, "lang": 0.9, "topic": 1.0}
SWEEPS = 12
TOLERANCE = 1e-9
#: Share of the largest sample that the targets allow.
KEEP_SHARE = 0.95
SEED = "mix"
DIMS = ("source", "lang", "topic")
#: topic -> words that speak for it; a parameter.
TOPICS = {
    "legal": "license licensed licence licensing copyright copyrighted rights reserved terms permission public gnu mit apache commons",
    "contact": "contact email mail e-mail phone call write address reach tel",
    "technical": "api key token secret password code error server version function class data software install",
    "commerce": "price order buy sale free offer shop cart pay discount deal",
}
#: Punctuation that may stand right after a word.
_AFTER = ("", ".", ",", ":", ";")
#: Every TABLE_BARS-th word at least is a bar: a table; a line end on LINE_WORDS words at least: lines.
TABLE_BARS, LINE_WORDS = 6, 12


def lexicon(topics: dict[str, str]) -> dict[str, list[str]]:
    return {t: [w + a for w in words.split() for a in _AFTER] for t, words in topics.items()}


def found_words(words: Column, topics: dict[str, str] = TOPICS) -> Column:
    """The words that speak for a topic: one look-up per word."""
    known = sorted({w for ws in lexicon(topics).values() for w in ws})
    return F.filter(words, lambda w: w.isin(known))


def topic_of(words: Column, found: Column, n_lines: Column, topics: dict[str, str] = TOPICS) -> Column:
    """Topic of a text from its lower-cased words, their ``found_words`` and its number of line ends.
    Give ``found`` as a computed column: as an expression it would be worked out again for every topic."""
    lists = lexicon(topics)

    def score(i: int, topic: str) -> Column:
        hits = F.filter(found, lambda w: w.isin(lists[topic]))
        return F.struct(F.size(hits).alias("n"), F.lit(-i).alias("i"), F.lit(topic).alias("topic"))

    scores = [score(i, t) for i, t in enumerate(lists)]
    best = F.array_max(F.array(*scores))
    n = F.size(words)
    register = (F.when(n == 0, F.lit("none")).when(F.size(F.filter(words, lambda w: w == "|")) * TABLE_BARS >= n, F.lit("table"))
                .when(n_lines * LINE_WORDS >= n, F.lit("lines")).otherwise(F.lit("prose")))
    return F.when(best["n"] > 0, best["topic"]).otherwise(register)


def features(df: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", key: str = "doc_id",
             topics: dict[str, str] = TOPICS, carry: Sequence[str] | None = None) -> DataFrame:
    """row, key, source, lang, topic, tokens of every document; ``row`` holds the columns
    ``carry``, else all of them."""
    none = F.lit("none")
    row = F.struct("*") if carry is None else F.struct(*[F.col(f"`{c}`") for c in carry])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.lower(t), WORD_GAP), "")
    d = computed(df.select(row.alias("row"), F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), none).alias("source"),
                           F.coalesce(F.col(lang).cast("string"), none).alias("lang"), words.alias("w"),
                           (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("n_lines")))
    d = computed(d.withColumn("found", found_words(F.col("w"), topics)))
    return computed(d.select("row", "key", "source", "lang", topic_of(F.col("w"), F.col("found"), F.col("n_lines"), topics).alias("topic"),
                             F.size("w").cast("long").alias("tokens")))


def cells_of(f: DataFrame) -> DataFrame:
    return f.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def flattened_targets(cells: DataFrame, flatten: dict[str, float] | None = None) -> DataFrame:
    """The default targets (dim, value, share)."""
    flatten = flatten or FLATTEN
    parts = []
    for dim in DIMS:
        m = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(flatten[dim])).alias("x"))
        total = m.agg(F.sum("x")).first()[0] or 1.0
        parts.append(m.select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), (F.col("x") / F.lit(total)).alias("share")))
    return reduce(DataFrame.unionByName, parts)


def goals(cells: DataFrame, targets: DataFrame, keep_share: float) -> DataFrame:
    """(dim, value, tokens, share, goal): expected tokens of every value that has a target;
    shares are renormalised over the values that occur."""
    have = reduce(DataFrame.unionByName, [
        cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens")).withColumn("dim", F.lit(d)) for d in DIMS])
    g = have.join(targets.select("dim", "value", "share"), ["dim", "value"])
    whole = g.groupBy("dim").agg(F.sum("share").alias("all"))
    g = g.join(whole, "dim").withColumn("share", F.col("share") / F.col("all"))
    size = keep_share * (g.agg(F.min(F.col("tokens") / F.col("share"))).first()[0] or 0.0)
    return g.select("dim", "value", "tokens", "share", (F.col("share") * F.lit(size)).alias("goal"))


def factor(dim: str) -> Column:
    """The f with sum of tokens * min(1, u * f) = goal over a value's cells: with the
    cells sorted by u, the largest ones at the bound; it is the largest candidate that
    leaves its own cell within the bound.  Beyond all tokens every cell is at the bound."""
    by = Window.partitionBy(dim).orderBy(F.col("u").desc(), *DIMS)
    capped = F.coalesce(F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("tokens") * F.col("u")).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (F.col("goal") - capped) / rest


def rake(cells: DataFrame, goal_table: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with p, the probability of a draw."""
    fitted = cells.withColumn("u", F.lit(1.0))
    for dim in DIMS:
        g = goal_table.where(F.col("dim") == dim).select(F.col("value").alias(dim), F.col("goal").alias(f"goal_{dim}"))
        fitted = fitted.join(g, dim, "left")
    fitted = written(fitted, "mix-cells")
    for _ in range(sweeps):
        for dim in DIMS:
            group = Window.partitionBy(dim)
            have = F.sum(F.col("tokens") * F.least(F.lit(1.0), "u")).over(group)
            fitted = fitted.withColumns({"goal": F.col(f"goal_{dim}"), "have": have})
            off = F.coalesce(F.abs(F.col("have") / F.col("goal") - 1), F.lit(0.0))
            fitted = fitted.withColumn("off", off if dim == DIMS[0] else F.greatest("off", off))
            fitted = fitted.withColumn("f", factor(dim))
            best = F.max(F.when(F.col("f") * F.col("u") <= 1, F.col("f"))).over(group)
            every = F.lit(1.0) / F.min("u").over(group)
            fitted = fitted.withColumn("u", F.when(F.col("goal").isNull(), F.col("u")).otherwise(
                F.col("u") * F.coalesce(best, every)))
        fitted = written(fitted.drop("goal", "have", "f"), "mix-cells")
        if (fitted.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
        fitted = fitted.drop("off")
    return fitted.select(*DIMS, "tokens", F.least(F.lit(1.0), "u").alias("p"))


def fit(df_features: DataFrame, targets: DataFrame | None = None, keep_share: float = KEEP_SHARE,
        sweeps: int = SWEEPS) -> tuple[DataFrame, DataFrame]:
    """(cells with p, goals), both written."""
    cells = written(cells_of(df_features), "mix-cells")
    goal_table = written(goals(cells, flattened_targets(cells) if targets is None else targets, keep_share), "mix-goals")
    return written(rake(cells, goal_table, sweeps), "mix-p"), goal_table


def report(raked: DataFrame, goal_table: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(dim, value, tokens, target, expected, met): the target share of every value, its
    expected share of the sample, and whether they agree."""
    size = raked.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0] or 1.0
    have = reduce(DataFrame.unionByName, [
        raked.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("p")).alias("drawn")).withColumn("dim", F.lit(d))
        for d in DIMS])
    g = goal_table.join(have, ["dim", "value"])
    expected = F.col("drawn") / F.lit(size)
    return g.select("dim", "value", "tokens", F.col("share").alias("target"), expected.alias("expected"),
                    (F.abs(expected - F.col("share")) <= tolerance).alias("met"))


def mix(df: DataFrame, targets: DataFrame | None = None, text: str = "text", source: str = "source", lang: str = "lang",
        key: str = "doc_id", keep_share: float = KEEP_SHARE, sweeps: int = SWEEPS, topics: dict[str, str] = TOPICS,
        carry: Sequence[str] | None = None) -> DataFrame:
    """``row`` (struct), the cell's columns, ``tokens``, ``p``, ``kept``.  With ``carry``, the
    (small) columns of the input that ``row`` is to hold, the words of a text are worked out
    once and the features written; whole rows are as large as the corpus, so that theirs
    are worked out twice instead: for the cells and for the result."""
    f = features(df, text, source, lang, key, topics, carry)
    if carry is not None:
        f = written(f, "mix-features")
    raked, _ = fit(f, targets, keep_share, sweeps)
    p = raked.select(*[F.col(d).alias(f"c_{d}") for d in DIMS], "p")
    joined = f.join(p, [F.col(d) == F.col(f"c_{d}") for d in DIMS], "left")
    prob = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.col("p"))
    return joined.select("row", *DIMS, "tokens", prob.alias("p"), (uniform(F.col("key"), SEED) < prob).alias("kept"))


def sample(df: DataFrame, targets: DataFrame | None = None, **options) -> DataFrame:
    """The drawn documents, with their own columns."""
    return computed(mix(df, targets, **options).select("row", "kept")).filter("kept").select("row.*")

"""Importance resampling towards a target distribution over hashed n-grams.

Features of a text are all runs of 1 to ``orders`` consecutive words; a feature
falls into the bucket crc32 of its UTF-8 bytes modulo ``BUCKETS``.  One pass
counts the buckets of the corpus and of the target texts, the gain of a bucket
is the logarithm of the two smoothed shares, a second pass sums the gains of
each document, and Gumbel noise from the id turns "the highest scores" into a
sample by importance weight.

Words come from a byte translation and a split, n-grams extend the crc32 of
their first words by the next one (the checksum's seed), and counters reduce
within a task, so a task sends at most ``BUCKETS`` rows.  Both counts are fixed
in size (``BUCKETS``), hence the gains travel in the closure.

The rank over the whole corpus needs no single task: scores are dealt out by
range (ties split further by id), and a table of one row per range carries the
offsets.

Defined results: a null text counts as empty; a text without words has no
features and weight 0.  Rows are judged one by one, so repeated ids or rows each
have a score, and equal rows take consecutive ranks.  A null id is hashed as
``null`` and comes after all others in a tie.  Ids of any orderable type are
kept as they are.  An empty corpus gives no rows; an empty target gives the
gains of zero counts.  Very long texts are read whole.  Only id and text are
read, so no extra column can clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.bytewords import Memo, raw, slices, words
from tracefold.llm.common import written

BUCKETS = 10000
ORDERS = 1
SEED = "2024"
#: share of the eligible documents that is drawn, as a fraction of integers
SHARE = (10, 100)
MIN_WORDS = 20


def longer(seeds: list[int], ws: list[bytes], n: int) -> list[int]:
    """crc32 of the runs of n words, from those of n - 1 words."""
    return [crc32(b" " + w, s) for s, w in zip(seeds, ws[n - 1:])]


def bucket_counts(df: DataFrame, text: str, buckets: int, orders: int) -> DataFrame:
    """(bucket, n) of all features, at most ``buckets`` rows a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in slices(batches):
            single: Counter = Counter()
            runs: Counter = Counter()
            for t in raw(b.column("t")):
                ws = words(t)
                single.update(ws)
                seeds = list(map(crc32, ws)) if orders > 1 else []
                for n in range(2, orders + 1):
                    seeds = longer(seeds, ws, n)
                    runs.update(seeds)
            for w, n in single.items():
                total[crc32(w) % buckets] += n
            for h, n in runs.items():
                total[h % buckets] += n
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], ["bucket", "n"])

    return df.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket long, n long")


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln of (target share / corpus share)) per bucket, counts smoothed by one."""
    size = len(corpus)
    total, goal = float(corpus.sum()) + size, float(target.sum()) + size
    return [math.floor(1000 * math.log((float(t) + 1) * total / ((float(s) + 1) * goal)))
            for s, t in zip(corpus.tolist(), target.tolist())]


def weights(df: DataFrame, gain: list[int], text: str, key: str, orders: int) -> DataFrame:
    """k, n_words, n_features, weight of every row."""
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: gain[crc32(w) % buckets])
        for b in slices(batches):
            n_words, n_features, weight = [], [], []
            for t in raw(b.column("t")):
                ws = words(t)
                count, total = len(ws), sum(map(memo.__getitem__, ws))
                seeds = list(map(crc32, ws)) if orders > 1 else []
                for n in range(2, orders + 1):
                    seeds = longer(seeds, ws, n)
                    count += len(seeds)
                    total += sum(gain[h % buckets] for h in seeds)
                n_words.append(len(ws))
                n_features.append(count)
                weight.append(total)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight))],
                ["k", "n_words", "n_features", "weight"])

    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, n_words long, n_features long, weight long")


def noise(key: str, seed: str):
    """floor(1000 * Gumbel) from the first 32 bits of sha256(seed:id)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(scored: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``rank`` (1, 2, ...) of the drawn rows of a written table (k, score,
    eligible, ...): the floor(share * eligible) highest scores, ties by k."""
    order = [F.col("score").desc(), F.col("k").asc_nulls_last(), F.col("u")]
    able = scored.where("eligible").withColumn("u", F.monotonically_increasing_id())
    ranged = written(able.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resample-ranged")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(every).alias("able")).withColumn("wanted", F.expr(f"able * {share[0]} div {share[1]}"))
    placed = ranged.join(offsets, "part").withColumn(
        "at", F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    ranked = placed.select(*scored.columns, F.when(F.col("at") <= F.col("wanted"), F.col("at")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where("NOT eligible").withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text",
             buckets: int = BUCKETS, orders: int = ORDERS, seed: str = SEED, share: tuple[int, int] = SHARE,
             min_words: int = MIN_WORDS) -> DataFrame:
    """Every row's ``key``, n_words, n_features, weight, score and rank (null: not drawn)."""
    both = bucket_counts(df, text, buckets, orders).withColumn("side", F.lit(0)).unionByName(
        bucket_counts(target, target_text, buckets, orders).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), dtype=np.int64)
    for r in both.groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 * buckets rows
        counts[r["side"], r["bucket"]] = r["n"]
    scored = written(weights(df, gains(counts[0], counts[1]), text, key, orders).select(
        "k", "n_words", "n_features", "weight", (F.col("weight") + noise("k", seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("eligible")), "resample-scored")
    return draw(scored, share).select(F.col("k").alias(key), "n_words", "n_features", "weight", "score", "rank")

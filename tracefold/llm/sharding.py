"""Sharding by extendible hashing, with DataFrame operations only.

A document's key hashes to 52 bits.  The directory is a binary trie over hash
prefixes: a bucket (depth, prefix) whose bytes exceed the limit splits on its
next bit, every other bucket is a shard.  The directory grows ``STEP`` bits per
round: rows under still oversized prefixes are pre-aggregated to at most
``2^STEP`` cells per prefix, the sums of the levels in between are windows over
those cells (never over rows), and each cell is told the shallowest bucket
above it that fits.  Rows of cells that fit are done; only rows of oversized
cells go into the next round, so a round's input shrinks, and the number of
rounds is the logarithm of the number of shards over ``STEP``.

Defined results: a null text has 0 bytes; a null key hashes like any other
value; rows repeating a key share a hash, so no bit separates them - such a
bucket, at full depth and still oversized, is cut into pages of half the limit
by a bucketed running sum (rows over half the limit get a page of their own).
A single row over the limit is alone in its page and marked ``oversized``.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import written
from tracefold.operators.scan import numeric_bucket, running_sum

BITS = 52
STEP = 8
#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def hash_bits(key: Column) -> Column:
    """52 hash bits of a key as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long")


def _split(cells: DataFrame, depth: int, reach: int, limit: int) -> DataFrame:
    """For each cell (prefix of ``reach`` bits) the shallowest depth in
    ``depth+1 .. reach`` (0 allowed in the first round) at which it fits."""
    first = None
    for d in range(reach, depth, -1):
        up = F.shiftright(F.col("cell"), reach - d)
        total = F.sum("cell_bytes").over(Window.partitionBy(up))
        cells = cells.withColumn(f"s{d}", total)
    for d in range(depth + 1, reach + 1):
        fits = F.when(F.col(f"s{d}") <= limit, F.lit(d))
        first = fits if first is None else F.coalesce(first, fits)
    return cells.select("cell", first.alias("depth"))


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text",
                  limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: ``key``, ``n_bytes``, ``depth``, ``prefix`` (the
    first ``depth`` hash bits), ``page`` (0 but for buckets no bit can split),
    ``shard`` (name of the three) and ``oversized``."""
    rows = written(df.select(
        F.col(key).alias("key"), hash_bits(F.col(key)).alias("h"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("rid")), "shard-rows")
    whole = rows.agg(F.sum("n_bytes")).first()[0] or 0
    names = ["key", "h", "n_bytes", "rid"]
    if whole <= limit:
        return _named(rows.withColumn("depth", F.lit(0)).withColumn("page", F.lit(0).cast("long")), key, limit)
    parts, left, depth = [], rows, 0
    while depth < BITS:
        reach = min(BITS, depth + STEP)
        cell = F.shiftright(F.col("h"), BITS - reach)
        cells = written(_split(left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes")),
                               depth, reach, limit), "shard-cells")
        told = left.withColumn("cell", cell).join(cells, "cell")
        parts.append(told.filter(F.col("depth").isNotNull()).select(*names, "depth").withColumn(
            "page", F.lit(0).cast("long")))
        open_cells = cells.filter(F.col("depth").isNull())
        depth = reach
        if open_cells.isEmpty():
            return _named(_union(parts), key, limit)
        left = written(told.filter(F.col("depth").isNull()).select(*names), "shard-rows")
    small = running_sum(left.filter(F.col("n_bytes") * 2 <= limit), ["h"], ["rid"], F.col("n_bytes"), "upto",
                        numeric_bucket("rid", 4096))
    half = max(1, limit // 2)
    parts.append(small.select(*names, F.lit(BITS).alias("depth"),
                              F.floor((F.col("upto") - F.col("n_bytes")) / half).cast("long").alias("page")))
    parts.append(left.filter(F.col("n_bytes") * 2 > limit).select(
        *names, F.lit(BITS).alias("depth"), (-F.col("rid") - 1).alias("page")))
    return _named(_union(parts), key, limit)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _named(rows: DataFrame, key: str, limit: int) -> DataFrame:
    prefix = F.expr(f"shiftright(h, {BITS} - depth)")
    name = F.concat(F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2),
                                                                     F.col("depth"), F.lit("0"))),
                    F.when(F.col("page") != 0, F.concat(F.lit("-"), F.col("page").cast("string"))).otherwise(""))
    return rows.select(F.col("key").alias(key), "n_bytes", F.col("depth").cast("long").alias("depth"),
                       prefix.cast("long").alias("prefix"), "page", name.alias("shard"),
                       (F.col("n_bytes") > limit).alias("oversized"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 limit: int = SHARD_BYTES) -> None:
    """Write the documents as one folder per shard under ``path`` (a shared URI).
    ``key`` must be unique here.  Rows are dealt by shard, one file each."""
    placed = df.alias("d").join(assign_shards(df, key, text, limit).select(
        F.col(key).alias("__key"), F.col("shard").alias("__shard")),
        F.col(f"d.{key}").eqNullSafe(F.col("__key"))).drop("__key")
    placed.repartition("__shard").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)

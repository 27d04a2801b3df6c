"""S3 as a stream sink: what T1 flushes becomes one bundle document a flush."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators import patterns as A
from tracefold.sources.bundles import assemble_bundles, write_bundles_batch


def flush_patterns(entries: DataFrame) -> DataFrame:
    """A2 over T1's flushed entries, ordered: the patterns of each (source, flush number).
    A flush holds no more than the stream's buffer, so its entries and its patterns
    are numbered in one window each, after one shuffle."""
    e = (_flushed(entries).withColumn("container", F.col("source_id")))
    arrival = Window.partitionBy("bundle_id").orderBy(F.col("ts").asc_nulls_first(), "file", "entry_no")
    e = e.withColumn("entry_no", F.row_number().over(arrival).cast("long"))
    return A.order_patterns_b(A.dedup_patterns_b(e), entry_bucket=None)


def _flushed(entries: DataFrame) -> DataFrame:
    return entries.where("flush_no >= 0").withColumn(
        "bundle_id", F.concat("source_id", F.lit("#"), F.col("flush_no").cast("string")))


def flush_bundles(entries: DataFrame, pats: DataFrame | None = None) -> DataFrame:
    """A2, A3, A5 and A10 over T1's flushed entries: one bundle for each
    (source, flush number), with the flush's reason, size and time.  ``pats`` are
    the entries' ``flush_patterns`` where they have been written already."""
    pats = flush_patterns(entries) if pats is None else pats
    flush = _flushed(entries).groupBy("bundle_id").agg(
        F.min("reason").alias("reason"), F.count(F.lit(1)).alias("log_count"), F.max("flushed_at").alias("flushed_at"))
    return assemble_bundles(pats, A.bundle_window(pats), affected=A.affected_services(pats),
                            hint=A.derive_hint(pats, level="error_class", ord_col="first_entry_no"), flush=flush)


def bundle_sink(path: str, query_id: str) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``.  The batch's entries are landed first, so that
    the stream's state is advanced by one action only, then their patterns, which
    most parts of a bundle are made of, and assembled from there.
    The folders are named by (query_id, batch_id) and overwritten: a replayed
    batch leaves the same documents."""
    def write(entries: DataFrame, batch_id: int) -> None:
        def landed(df: DataFrame, name: str) -> DataFrame:
            folder = f"{path}/{name}/{query_id}/batch_id={batch_id}"
            df.write.mode("overwrite").parquet(folder)
            return df.sparkSession.read.schema(df.schema).parquet(folder)

        batch = landed(entries, "entries")
        write_bundles_batch(flush_bundles(batch, landed(flush_patterns(batch), "patterns")), batch_id, f"{path}/bundles", query_id)
    return write


def read_sink(spark, path: str, query_id: str) -> DataFrame:
    """The sink's documents: ``json`` and their ``batch_id``."""
    return spark.read.text(f"{path}/bundles/{query_id}").withColumnRenamed("value", "json")

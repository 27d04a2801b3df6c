"""Materialise a shared intermediate table once.

A DataFrame consumed by several branches of one plan is recomputed per branch
when column pruning makes the branches differ (no exchange reuse).  Shared
intermediates (the pattern table) are written once as a parquet table in the
cluster's ``spark.checkpoint.dir`` and read back: the lineage is cut there, so
a lost executor re-reads the table instead of recomputing the whole chain, and
later stages read columnar files (pruned to the columns they use)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tracefold.session import delete_on_exit, ensure_checkpoint_dir


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tracefold-tables/{name}-{uuid.uuid4().hex[:12]}"
    delete_on_exit(spark, path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

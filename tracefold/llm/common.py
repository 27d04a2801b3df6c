"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.session import ensure_checkpoint_dir, prepare

#: Words are the runs between these ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names (shared by
    driver and executors); it is deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared checkpoint folder
    and read it back.  A lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed at this point: a later filter on one of
    them stays above.  Pushed below, it would repeat the expression - inside a
    higher-order function once per element."""
    row = F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("x")
    return df.select(row).select("x.*")


def text_id(text: Column) -> list[Column]:
    """Two 64-bit hashes that together identify a text (128 bits)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("second"), t).alias("t2")]


def uniform(key: Column, seed: str) -> Column:
    """A repeatable uniform number in [0, 1) per key: 52 bits of md5, which
    another SQL engine computes alike."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

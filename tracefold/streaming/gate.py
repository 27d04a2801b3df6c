"""Late rows of a stream: a gate in front of the windowed aggregations.

Spark's stateful operators drop rows behind the watermark without a trace.  The
gate is a query of its own that judges every row before: a row is late where its
event time is more than ``delay`` behind the newest time of all *earlier*
micro-batches, or where it has none.  Late rows go to a side table that can be
counted and replayed; the others go to a folder that the windowed query reads as
its stream.  That query's watermark, with the same delay and over the rows that
passed, never overtakes the gate's, so it drops nothing.

Each micro-batch is written under its ``batch_id``: the late rows and the batch's
newest time first, the passed rows last.  The passed folder's ``_SUCCESS`` is the
commit: a replayed batch that has it is left alone, any other is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def newest_before(spark: SparkSession, path: str, batch_id: int):
    """The newest event time of the micro-batches before ``batch_id``, or None."""
    if not batch_id or not _exists(spark, f"{path}/newest"):
        return None
    marks = spark.read.schema("newest timestamp_ntz, batch_id long").parquet(f"{path}/newest")
    return marks.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]


def gate_batch(batch: DataFrame, batch_id: int, path: str, delay_seconds: int, ts: str = "ts") -> None:
    """``foreachBatch`` sink: ``path``/passed, ``path``/late and ``path``/newest, each by ``batch_id``."""
    spark = batch.sparkSession
    if _exists(spark, f"{path}/passed/batch_id={batch_id}/_SUCCESS"):
        return
    newest = newest_before(spark, path, batch_id)
    behind = F.lit(False) if newest is None else (
        F.col(ts).cast("timestamp_ntz") < F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(delay_seconds)))
    judged = batch.withColumn("__late", F.col(ts).isNull() | behind).persist()
    try:
        judged.where("__late").drop("__late").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        (judged.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("newest")).write.mode("overwrite")
         .parquet(f"{path}/newest/batch_id={batch_id}"))
        judged.where("NOT __late").drop("__late").write.mode("overwrite").parquet(f"{path}/passed/batch_id={batch_id}")
    finally:
        judged.unpersist()


def start_gate(stream: DataFrame, path: str, checkpoint: str, delay_seconds: int, ts: str = "ts"):
    return (stream.writeStream.foreachBatch(lambda b, i: gate_batch(b, i, path, delay_seconds, ts))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def passed_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The passed rows as a stream; a run takes all that the gate has written since the
    last one as a whole.  Cut within a batch of the gate, the newest time of the first
    files could move the watermark past rows of the others."""
    return spark.readStream.schema(schema).parquet(f"{path}/passed/batch_id=*")


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/late/batch_id=*")

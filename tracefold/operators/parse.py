"""P1 parse_lines (variant A) and P2 fold_entries (variant B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.functions import time as TM
from tracefold.operators.scan import carry_forward_max, numeric_bucket

# Java stack frame reference ``at pkg.Class.method(File.java:123)``; groups 3, 4.
STACK_FILE_RE = r"at\s+([\w.$]+)\.([\w$]+)\(([\w.]+):(\d+)\)"

DEFAULT_LINE_BUCKET = 1 << 16


def non_blank(line) -> F.Column:
    return line.rlike(r"\S")


def parse_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """One row per non-blank physical line with ts, severity, normalised
    pattern and the Java source file/line it cites (if any)."""
    line = F.col(line_col)
    file_ = F.regexp_extract(line, STACK_FILE_RE, 3)
    return (lines.where(non_blank(line))
            .withColumn("ts", TM.ts_a(line))
            .withColumn("severity", T.severity_a(line))
            .withColumn("norm", T.norm_a(line))
            .withColumn("src_file", F.when(file_ != "", file_))
            .withColumn("src_line", F.when(file_ != "", F.regexp_extract(line, STACK_FILE_RE, 4).cast("int"))))


def fold_entries(lines: DataFrame, keys: tuple[str, ...] = ("source_id",), order: str = "line_no",
                 carry: tuple[str, ...] = ("container",), bucket_width: int = DEFAULT_LINE_BUCKET) -> DataFrame:
    """Fold multi-line entries.  A line whose stripped text starts with a
    timestamp opens an entry; every other non-blank line is appended (with
    ``\\n``) to the entry opened last.  Lines before the first head are dropped.
    ts and level come from the head line.

    Output ``(*keys, entry_no, ts, level, message, *carry)``; ``entry_no`` is the
    head line's ``order`` value, so it keeps arrival order."""
    from tracefold.plans.materialize import materialize
    keys = list(keys)
    d = lines.where(non_blank(F.col("line"))).select(
        *keys, order, "line", *carry, F.when(TM.is_head_b(F.col("line")), F.col(order)).alias("__head"))
    # written once: the scan reads its input twice, the second time without the lines' text
    d = carry_forward_max(materialize(d, "marked_lines"), keys, [order], F.col("__head"), "entry_no",
                          numeric_bucket(order, bucket_width))
    d = d.where(F.col("entry_no").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("l"))))
    agg = [F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("message")]
    agg += [F.min_by(F.col(c), F.col(order)).alias(c) for c in carry]
    e = d.groupBy("entry_no", *keys).agg(*agg)   # the number first: sorting by it tells most rows apart
    head = F.substring_index(F.col("message"), "\n", 1)
    return e.select(*keys, "entry_no", TM.ts_b(head).alias("ts"), T.level_b(head).alias("level"),
                    "message", *carry)


def read_log_lines(spark, path: str, split_bytes: int | None = None) -> DataFrame:
    """Text files -> ``(source_id, line_no, line)``; blank lines are counted, then dropped.

    Each file is one ordered source and is read by as many tasks as it has splits.
    A scan numbers the rows of a task in order, so a line's number is its distance
    to the first row of its split (``file_block_start``) plus the lines of the
    file's earlier splits, a prefix sum over one row per split.  The numbered scan
    is written once, as another scan could be cut into other splits; lines are never
    shuffled unless that split table is too large to be broadcast.  ``split_bytes``
    replaces the session's split size for this scan."""
    from tracefold.plans.materialize import materialize
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "\r$", "").alias("line"))
    setting = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    try:
        if split_bytes:
            spark.conf.set(setting, str(split_bytes))
        rows = materialize(raw, "log_lines")
    finally:
        spark.conf.set(setting, usual)
    splits = rows.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("source_id", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (rows.where(non_blank(F.col("line"))).join(offsets, ["source_id", "block"])
            .select("source_id", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("line_no"), "line"))

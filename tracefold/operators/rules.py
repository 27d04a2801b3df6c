"""Safety rules as tables: S7 rule documents, J6 matrix overrides, J5 command rules.

Rules belong to a tenant (the service whose configuration holds them).  S7 turns
configuration documents into two tables:

* command rules ``(tenant, rule_no, kind, pattern)``: ``block`` patterns are regular
  expressions, ``allow`` patterns are base words;
* matrix overrides ``(tenant, rule_no, environment, scope, level)``.

J6 is an equi join on (tenant, environment, scope) with the first override of each.
J5 judges distinct (tenant, command) pairs once: user rules join on the tenant, so
the regex is a residual condition of an equi join; the system's own list is a fixed
table of a few dozen rows.  ``row_number`` keeps the rule that comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.operators.decide import (APPROVAL, APPROVAL_COMMANDS, BLOCKED, BLOCKED_PATTERNS, SAFE, SAFE_COMMANDS,
                                        _strip, base_command)

RULES_SCHEMA = ("allowed_commands array<string>, blocked_patterns array<string>, "
                "matrix_overrides array<struct<environment:string,scope:string,level:string>>")
#: Order in which rules are asked; the matrix stands between block and allow rules.
USER_BLOCK, SYSTEM_BLOCK, USER_ALLOW, SYSTEM_WORD = 0, 1, 3, 4


def read_rule_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(tenant, json)`` of the files ``path``/tenant.json; none where ``path`` is missing."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], "tenant string, json string")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("tenant"), F.col("value").alias("json"))


def load_rules(documents: DataFrame, json_col: str = "json", tenant: str = "tenant") -> tuple[DataFrame, DataFrame]:
    """(command rules, matrix overrides) of the documents, in document order.
    A document that is no JSON object gives no rules; a missing level asks for approval."""
    d = documents.select(F.col(tenant).alias("tenant"), F.from_json(json_col, RULES_SCHEMA).alias("r"))

    def listed(field: str, kind: str) -> DataFrame:
        return d.select("tenant", F.posexplode(f"r.{field}").alias("rule_no", "pattern")).where("pattern IS NOT NULL").select(
            "tenant", F.col("rule_no").cast("long"), F.lit(kind).alias("kind"), "pattern")

    commands = listed("blocked_patterns", "block").unionByName(listed("allowed_commands", "allow"))
    overrides = d.select("tenant", F.posexplode("r.matrix_overrides").alias("rule_no", "o")).select(
        "tenant", F.col("rule_no").cast("long"), "o.environment", "o.scope",
        F.coalesce("o.level", F.lit(APPROVAL)).alias("level"))
    return commands, overrides


def fixed_matrix(environment: Column, scope: Column, mode: Column) -> Column:
    return (F.when((scope == "SOURCE_CODE") & (mode == "DIRECT_APPLY"), BLOCKED)
            .when((scope == "INFRA") & (environment == "DEV") & (mode == "DIRECT_APPLY"), SAFE).otherwise(APPROVAL))


def with_matrix(actions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds ``matrix_level`` and ``matrix_rule`` (``user`` or ``system``)."""
    first = Window.partitionBy("tenant", "environment", "scope").orderBy("rule_no")
    o = overrides.withColumn("n", F.row_number().over(first)).where("n = 1").select(
        "tenant", "environment", "scope", F.col("level").alias("__override"))
    level = F.coalesce("__override", fixed_matrix(F.col("environment"), F.col("scope"), F.col("execution_mode")))
    return (actions.join(o, ["tenant", "environment", "scope"], "left").withColumn("matrix_level", level)
            .withColumn("matrix_rule", F.when(F.col("__override").isNotNull(), "user").otherwise("system")).drop("__override"))


def system_rules(spark: SparkSession) -> DataFrame:
    """(precedence, rule_no, kind, pattern, level) of the fixed lists."""
    rows = [(SYSTEM_BLOCK, n, "regex", p, BLOCKED) for n, p in enumerate(BLOCKED_PATTERNS)]
    rows += [(SYSTEM_WORD, n, "word", w, lvl) for n, (w, lvl) in enumerate(
        [(w, SAFE) for w in SAFE_COMMANDS] + [(w, APPROVAL) for w in APPROVAL_COMMANDS])]
    return spark.createDataFrame(rows, "precedence int, rule_no long, kind string, pattern string, level string")


def matched_rules(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """(tenant, command, precedence, rule_no, origin, pattern, level) of every rule that
    a distinct command meets."""
    distinct = commands.select("tenant", "command").distinct().withColumn("c", _strip(F.col("command"))).where("c <> ''")
    distinct = distinct.withColumn("base", base_command(F.col("c")))
    columns = ["tenant", "command", "precedence", "rule_no", "origin", "pattern", "level"]

    def hits(joined: DataFrame, origin: str) -> DataFrame:
        return joined.withColumn("origin", F.lit(origin)).select(*columns)

    block = rules.where("kind = 'block'").select("tenant", "rule_no", "pattern").withColumns(
        {"precedence": F.lit(USER_BLOCK), "level": F.lit(BLOCKED)})
    allow = rules.where("kind = 'allow'").select("tenant", "rule_no", "pattern").withColumns(
        {"precedence": F.lit(USER_ALLOW), "level": F.lit(SAFE)})
    system = system_rules(commands.sparkSession)  # fixed number of rows
    b = block.withColumnRenamed("tenant", "t")
    user_block = distinct.join(b, (F.col("tenant") == F.col("t")) & F.expr("c rlike pattern")).drop("t")
    user_allow = distinct.join(allow.withColumn("base", F.col("pattern")), ["tenant", "base"])
    system_block = distinct.join(F.broadcast(system.where("kind = 'regex'")), F.expr("c rlike pattern"))
    word = distinct.join(F.broadcast(system.where("kind = 'word'")), F.col("base") == F.col("pattern")).withColumn(
        "level", F.when(F.col("c").contains(">") | F.col("c").contains("|"), F.lit(APPROVAL)).otherwise(F.col("level")))
    return hits(user_block, "user").unionByName(hits(system_block, "system")).unionByName(
        hits(user_allow, "user")).unionByName(hits(word, "system"))


def classify(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """``actions`` (tenant, command, matrix_level or null, ...) with ``level``,
    ``decided_by`` (user, system, matrix or default) and the ``rule`` that decided."""
    hit = matched_rules(actions, rules)
    order = Window.partitionBy("tenant", "command", "stage").orderBy("precedence", "rule_no")
    first = (hit.withColumn("stage", F.when(F.col("precedence") <= SYSTEM_BLOCK, "block").otherwise("word"))
             .withColumn("n", F.row_number().over(order)).where("n = 1"))
    best = first.groupBy("tenant", "command").agg(*[
        F.max(F.when(F.col("stage") == s, F.struct("level", "origin", "pattern"))).alias(s) for s in ("block", "word")])
    stops = F.coalesce(F.col("matrix_level").isin(BLOCKED, APPROVAL), F.lit(False))
    none = F.lit(None).cast("string")
    chosen = (F.when(F.col("block").isNotNull(), F.col("block"))
              .when(stops, F.struct(F.col("matrix_level").alias("level"), F.lit("matrix").alias("origin"), none.alias("pattern")))
              .when(F.col("word").isNotNull(), F.col("word"))
              .otherwise(F.struct(F.lit(APPROVAL).alias("level"), F.lit("default").alias("origin"), none.alias("pattern"))))
    # an empty command meets no rule and is not asked of the matrix
    empty = F.coalesce(_strip(F.col("command")), F.lit("")) == ""
    d = actions.withColumn("__c", F.coalesce("command", F.lit(""))).join(
        best.withColumnRenamed("command", "__c"), ["tenant", "__c"], "left").withColumn("__d", chosen)
    return d.withColumn("level", F.when(empty, APPROVAL).otherwise(F.col("__d.level"))).withColumn(
        "decided_by", F.when(empty, "default").otherwise(F.col("__d.origin"))).withColumn(
        "rule", F.when(~empty, F.col("__d.pattern"))).drop("__c", "__d", "block", "word")

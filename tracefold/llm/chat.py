"""Chat formatting by quotation linking.

Messages quote earlier ones mail-style: a line starting with ``>`` marks is quoted
at a level (the number of marks), and one message can hold nested levels.

1. Each text is parsed once into its own lines and its quoted passages (runs of
   lines at one level); an attribution line right above a passage is dropped.
2. Lines are normalised (lower case, letters and digits only; lines without any
   are left out) and a passage is hashed as a whole.  An original message can
   hold it as any run of its own lines: runs are hashed only where a line begins
   some passage of the conversation, and only in the lengths asked for.
3. Passage hashes join run hashes: a passage belongs to the latest earlier message
   that wrote it, an as-of scan per (conversation, passage hash) cut into buckets
   of messages, so that a passage everybody writes is not one task.
4. The message replied to is the origin of the passage with the lowest level, the
   last of these; without a linked quote it is the previous message.
5. Depth in the reply tree comes from pointer doubling over message numbers.
   Messages are placed in reply order - by depth, then number - and formatted
   without their quotes.

Messages are numbered by (turn, role, text) within their conversation, nulls
first, and every link is between numbers, so messages that share a turn stay
apart.

Defined results: a null text or role is empty; rows equal in all four fields are
one message, no others are merged; a message without a conversation id is a
conversation of its own; ids and turns keep their type and their nulls; a quote
with no origin is still cut; very long texts are parsed whole; only the four
columns are read, so no extra column can clash; empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import written
from tracefold.operators.scan import carry_forward_max, numeric_bucket, ordinal

_MARKS = re.compile(r"\A[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"\A.{0,200}\bwrote:\s*\Z")


def split_quotes(text: str | None) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Own lines, and quoted lines as (passage number, level, line)."""
    own, quoted, passage, last = [], [], -1, 0
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level = m.group(1).count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not last:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ATTRIBUTION.match(own[-1]):
                    own.pop()
            if level > last and quoted and _ATTRIBUTION.match(quoted[-1][2]) and quoted[-1][1] == last:
                quoted.pop()  # the attribution of the deeper passage
                passage -= not quoted or quoted[-1][0] != passage
            if level != last:
                passage += 1
            quoted.append((passage, level, line[m.end():]))
        last = level
    return own, quoted


def parse(df: DataFrame, text: str) -> DataFrame:
    """Adds own (text without quotes), own_lines, quotes (passage, level, line)."""
    columns = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("line", pa.string())]))
        for b in batches:
            parsed = [split_quotes(t.as_py()) for t in b.column(text)]
            quotes = [[{"passage": p, "level": n, "line": x} for p, n, x in q] for _, q in parsed]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(["\n".join(o).strip() for o, _ in parsed], pa.string()),
                 pa.array(quotes, kind)], [*columns, "own", "quotes"])

    return df.mapInArrow(run, f"{schema}, own string, quotes array<struct<passage:int,level:int,line:string>>")


def line_hash(line: Column) -> Column:
    """Hash of a normalised line; null for a line without letters or digits."""
    plain = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", F.md5(plain))


def runs(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """conv, n, h: hashes of the runs of own lines that begin like a passage of the
    conversation and are as long."""
    lines = messages.select("conv", "n", F.filter(F.transform(F.split("own", "\n"), line_hash),
                                                  lambda h: h.isNotNull()).alias("lines"))
    starts = lines.select("conv", "n", F.posexplode("lines").alias("i", "first"))
    wanted = starts.join(asked.select("conv", "first", "size").distinct(), ["conv", "first"])
    places = wanted.groupBy("conv", "n").agg(F.collect_set(F.struct("i", "size")).alias("places"))
    cut = F.transform(F.filter("places", lambda p: p["i"] + p["size"] <= F.size("lines")),
                      lambda p: F.md5(F.concat_ws(",", F.slice("lines", p["i"] + 1, p["size"]))))
    return lines.join(places, ["conv", "n"]).select("conv", "n", F.explode(F.array_distinct(cut)).alias("h"))


def link(messages: DataFrame) -> DataFrame:
    """conv, n, passage, level, origin (number or null) of every quoted passage."""
    quoted = messages.select("conv", "n", F.posexplode("quotes").alias("i", "q")).select(
        "conv", "n", "i", "q.passage", "q.level", line_hash(F.col("q.line")).alias("h"))
    whole = F.transform(F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("i", "h")))), lambda x: x["h"])
    passages = written(quoted.groupBy("conv", "n", "passage", "level").agg(whole.alias("lines")).select(
        "conv", "n", "passage", "level", F.get("lines", F.lit(0)).alias("first"), F.size("lines").alias("size"),
        F.when(F.size("lines") > 0, F.md5(F.concat_ws(",", "lines"))).alias("h")), "quotes")
    asked = passages.filter("h is not null")
    wrote = runs(messages, asked).select("conv", "h", "n", F.lit(1).alias("order"), F.col("n").alias("mark"),
                                         F.lit(None).cast("int").alias("passage"))
    events = wrote.unionByName(asked.select("conv", "h", "n", F.lit(0).alias("order"), F.lit(None).cast("long").alias("mark"),
                                            "passage"))
    # quotes of a message come before what it writes itself, so "last so far" is an earlier message
    seen = carry_forward_max(events, ["conv", "h"], ["n", "order"], F.col("mark"), "origin", numeric_bucket("n", 64))
    origins = seen.filter("order = 0").select("n", "passage", "origin")
    return passages.select("conv", "n", "passage", "level").join(origins, ["n", "passage"], "left")


def reply_depth(messages: DataFrame) -> DataFrame:
    """conv, n, parent -> with depth and root, by pointer doubling.  Messages
    whose pointer has reached a root are settled; a round joins only the others,
    and only with messages of conversations that still have any."""
    start = written(messages.select("conv", "n", "parent", F.coalesce("parent", "n").alias("up"),
                                    F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "replies")
    settled, active, state = start.filter("parent is null"), start.filter("parent is not null"), start
    while True:
        above = state.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = written(active.join(above, "up").select(
            "conv", "n", "parent", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("up") != F.col("up2")).alias("moved")), "replies")
        settled = settled.unionByName(new.filter("not moved").drop("moved"))
        active = new.filter("moved").drop("moved")
        if active.isEmpty():
            return settled.select("n", "depth", F.col("up").alias("root"))
        state = settled.unionByName(active).join(active.select("conv").distinct(), "conv", "left_semi")


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The distinct messages with ``n``, increasing in (conversation, turn, role,
    text): dealt out by range, sorted and counted up part by part."""
    base = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    order = ["conv_id", "turn", "role", "text"]
    ranged = base.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.when(F.col("conv_id").isNull(), F.concat(F.lit("message "), F.col("n").cast("string"))).otherwise(
        F.concat(F.lit("id "), F.col("conv_id").cast("string")))
    return written(ranged.withColumn("n", F.monotonically_increasing_id()).withColumn("conv", own), "messages")


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, root_turn, depth,
    position, n_passages, n_linked, text (own lines), formatted."""
    messages = written(parse(numbered(df, conv, turn, role, text), "text"), "parsed")
    passages = link(messages)
    per = passages.groupBy("n").agg(
        F.count("*").alias("n_passages"), F.count("origin").alias("n_linked"),
        F.max(F.when(F.col("origin").isNotNull(), F.struct(-F.col("level"), F.col("passage"), F.col("origin")))).alias("best"))
    # the previous message of the conversation, as a scan that spreads a long conversation
    marks = messages.select("conv", "n", F.lit(1).alias("order"), F.col("n").alias("mark")).unionByName(
        messages.select("conv", "n", F.lit(0).alias("order"), F.lit(None).cast("long").alias("mark")))
    before = carry_forward_max(marks, ["conv"], ["n", "order"], F.col("mark"), "previous",
                               numeric_bucket("n", 64)).filter("order = 0").select("conv", "n", "previous")
    parents = written(before.join(per, "n", "left").select(
        "conv", "n", F.coalesce("best.origin", "previous").alias("parent"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "parents")
    tree = reply_depth(parents)
    whole = messages.select("conv", "n", "conv_id", "turn", "role", "own").join(parents.drop("conv"), "n").join(tree, "n")
    turns = messages.select("n", "turn")
    named = whole.join(turns.select(F.col("n").alias("parent"), F.col("turn").alias("parent_turn")), "parent", "left").join(
        turns.select(F.col("n").alias("root"), F.col("turn").alias("root_turn")), "root")
    placed = ordinal(named, ["conv"], ["depth", "n"], F.struct("depth", numeric_bucket("n", 64).alias("t")), "position")
    return placed.select(
        F.col("conv_id").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "parent_turn", "root_turn", "depth",
        F.col("position").cast("long").alias("position"), "n_passages", "n_linked", F.col("own").alias("text"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "own").alias("formatted"))


def as_mail(df: DataFrame) -> DataFrame:
    """A mail view of ``conversations`` that Spark derives: every message that is
    not the first quotes the one it answers (two turns back when the turn is a
    multiple of 4, else the one before), with that one's own quote nested below,
    then writes its text; turns 3, 8, 13 ... quote nothing."""
    base = df.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("turn")
    to = F.when((t > 0) & (t % 5 != 3), F.when((t % 4 == 0) & (t >= 2), t - 2).otherwise(t - 1))
    base = base.withColumn("to", to)
    one = base.select("conv_id", F.col("turn").alias("to"), F.col("text").alias("text1"), F.col("to").alias("to1"),
                      F.col("role").alias("role1"))
    two = base.select("conv_id", F.col("turn").alias("to1"), F.col("text").alias("text2"), F.col("role").alias("role2"))
    full = base.join(one, ["conv_id", "to"], "left").join(two, ["conv_id", "to1"], "left")

    def quote(x: Column, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(x, "\n", "\n" + mark))

    nested = F.when(F.col("text2").isNotNull(), F.concat(F.lit("> "), F.col("role2"), F.lit(" wrote:\n"),
                                                         quote(F.col("text2"), "> > "), F.lit("\n")))
    mail = F.when(F.col("text1").isNotNull(), F.concat(F.col("role1"), F.lit(" wrote:\n"), F.coalesce(nested, F.lit("")),
                                                       quote(F.col("text1"), "> "), F.lit("\n\n")))
    return full.select("conv_id", "turn", "role", F.concat(F.coalesce(mail, F.lit("")), "text").alias("text"))

"""Rows that must not be merged or dropped: messages that share a turn, rows that
share an id, pages with an open head; ids of any type."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracefold.llm import chat, html_extract, topk

CHAT = "conv_id long, turn long, role string, text string"


def chat_of(spark, rows, schema=CHAT):
    df = spark.createDataFrame(rows, schema)
    for c in ("n", "conv", "own", "quotes", "h", "parent", "depth"):
        df = df.withColumn(c, F.lit(7))
    return chat.format_chat(df).collect()


def test_no_message_is_merged_with_another(spark):
    rows = [(1, 1, "a", "one"), (1, 1, "a", "two"), (1, 1, "b", "one"), (1, None, "a", "three"), (1, None, "a", "four"),
            (None, 1, "a", "one"), (None, 1, "a", "five"), (None, None, None, None), (1, 1, "a", "one")]
    got = chat_of(spark, rows)
    assert Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in got) == Counter(
        {(c, t, r or "", x or "") for c, t, r, x in rows})
    alone = [r for r in got if r["conv_id"] is None]
    assert len(alone) == 3 and all(r["depth"] == 0 and r["position"] == 0 for r in alone)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["text"] for r in one] == ["four", "three", "one", "two", "one"]  # nulls first, then by role and text
    assert [r["depth"] for r in one] == [0, 1, 2, 3, 4]


def test_ids_and_turns_of_other_types(spark):
    rows = [("x", "2026-01-01", "a", "first words"), ("x", "2026-01-02", "b", "other"), ("x", "2026-01-03", "a", "> first WORDS!\nyes")]
    got = {r["turn"]: r for r in chat_of(spark, rows, "conv_id string, turn string, role string, text string")}
    assert got["2026-01-03"]["parent_turn"] == "2026-01-01" and got["2026-01-03"]["text"] == "yes"


def test_a_passage_is_linked_as_a_whole(spark):
    """Runs of lines within a message count, single lines of a passage do not."""
    rows = [(1, 0, "a", "alpha\nbeta\n\ngamma\ndelta"), (1, 1, "b", "beta\ndelta"), (1, 2, "c", "> Beta.\n> gamma\nmiddle"),
            (1, 3, "d", "> beta\n> alpha\nwrong order"), (1, 4, "e", "> delta\nlatest"), (1, 5, "f", "> --\n>\nblank")]
    got = {r["turn"]: r for r in chat_of(spark, rows)}
    assert [got[t]["n_linked"] for t in range(6)] == [0, 0, 1, 0, 1, 0]
    assert [got[t]["parent_turn"] for t in range(6)] == [None, 0, 0, 2, 1, 4]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_origins_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for c in range(3):
        own = []
        for t in range(40):
            text = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
            quote = [rng.choice("abc") for _ in range(rng.randint(1, 3))] if t and rng.random() < 0.7 else []
            origin = max((i for i, o in enumerate(own) if any(o[k:k + len(quote)] == quote for k in range(len(o)))),
                         default=None) if quote else None
            expected[c, t] = origin if origin is not None else t - 1 if t else None
            rows.append((c, t, "u", "\n".join(["> " + q for q in quote] + text)))
            own.append(text)
    rng.shuffle(rows)
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in chat_of(spark, rows)} == expected


def test_a_long_text(spark):
    long = "\n".join(f"line {i} of a long message" for i in range(20000))
    got = {r["turn"]: r for r in chat_of(spark, [(1, 0, "a", long), (1, 1, "b", "no"), (1, 2, "c", "\n".join(
        "> " + x for x in long.split("\n")[500:15000]) + "\nyes")])}
    assert got[2]["parent_turn"] == 0 and got[2]["text"] == "yes" and got[0]["text"] == long


def all_pairs(rows, asked, k):
    out = []
    for q, v in rows:
        if asked(q):
            best = sorted((-sum(int(a * 256) * int(b * 256) for a, b in zip(v, w)), c) for c, w in rows if c != q)
            out += [(q, n, c, -s) for n, (s, c) in enumerate(best[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_top_k_with_repeated_ids(spark, kind):
    make = (lambda i: i) if kind == "long" else (lambda i: f"id{i}")
    rows = [(make(0), [1.0, 0.0])] * 8 + [(make(1), [1.0, 0.0]), (make(2), [1.0, 0.0]), (make(3), [0.5, 0.0])]
    rows += [(make(4), [1.0, 0.0])] * 12 + [(make(5), [0.0, 1.0])]
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>").withColumn("v", F.lit(1)).withColumn(
        "id", F.lit(2)).withColumn("q", F.lit(3))
    asked = [make(0), make(4), make(5)]
    got = sorted(tuple(r) for r in topk.top_k_embeddings(df, F.col("vec_id").isin(asked)).collect())
    assert got == all_pairs(rows, lambda i: i in asked, 5)


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>x</title><article><p>Some words of the story that is told here, and more of them.</p></article>",
     "Some words of the story that is told here, and more of them."),
    ("<head><meta charset=utf-8><title>x</title><div class=content><p>Words of a text that begins without a body tag and goes on for a while.",
     "Words of a text that begins without a body tag and goes on for a while."),
    ("<html><head><title>x</title></head><body><article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is what "
     "we look at in this rather long paragraph.</p></article></body>",
     "The sum a+b is what we look at in this rather long paragraph."),
    ("<head><noscript><img src=x></noscript><script>var a = '<p>';</script><style>p {}</style><body><article><p>Only this "
     "sentence is text of the page, and nothing of its head.</p></article>",
     "Only this sentence is text of the page, and nothing of its head."),
])
def test_pages_that_leave_the_head_open_or_hold_formulas(page, text):
    model = html_extract.train([])
    assert html_extract.extract([page], model) == [text]

"""op11 to op13: importance resampling, ranked lexical search, the quality model."""

import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from test_edges import EXTRA, odd_rows  # noqa: E402
from tracefold.llm import bytewords, lexical, quality_model, resample  # noqa: E402
from tracefold.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def corpus(seed, n, vocabulary=60):
    """Texts over a skewed vocabulary, so that many scores tie."""
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcé1") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 25, 25, 60, 400])
        rows.append((i, rng.choice([" ", "-", "\n"]).join(voc[int(rng.random() ** 3 * len(voc))] for _ in range(size))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " .,;"), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]),
                   (n + 3, "ÄÖ ÄÖ AB ab")]


@pytest.fixture(scope="module")
def odd(spark):
    return [(r[0], r[1]) for r in odd_rows()] + corpus(1, 60)


def extra(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA) if c not in df.columns])


@pytest.mark.parametrize("orders,buckets", [(1, 10000), (3, 97)])
def test_resample_against_plain_python(spark, odd, orders, buckets):
    target = [t for _, t in corpus(2, 15)]
    df = extra(spark.createDataFrame(odd, DOCS)).repartition(5)
    goal = extra(spark.createDataFrame([(t,) for t in target], "text string"))
    got = resample.resample(df, goal, orders=orders, buckets=buckets, share=(40, 100))
    rows = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)
    assert rows == brute.resampled(odd, target, buckets, orders, (40, 100))
    assert sum(r[4] is not None for r in rows) > 10


def test_resample_of_empty_tables_and_other_ids(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([("b", "x " * 30), ("a", "x " * 30), (None, "y " * 30)], "doc_id string, text string")
    assert resample.resample(none, none).count() == 0
    assert resample.resample(none, some).count() == 0
    got = resample.resample(some, none, share=(100, 100)).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]


def test_resample_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, 7, i % 10 != 0) for i in range(1000)] + [(5, 7, True)] * 50,
                                   "k long, score long, eligible boolean").repartition(7)
    out = resample.draw(resample.written(scored, "t"), (1, 2)).where("rank IS NOT NULL").orderBy("rank").collect()
    able = sorted([i for i in range(1000) if i % 10] + [5] * 50)
    assert [r["k"] for r in out] == able[:len(able) // 2]
    assert [r["rank"] for r in out] == list(range(1, len(able) // 2 + 1))


def searched(spark, docs, items, **kw):
    d, q = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS)
    out = lexical.rank(extra(d), extra(q), **kw)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


ITEM_ROWS = [(i, t) for i, t in corpus(3, 20) if i is not None and i != 3] + [
    (100, "a a a a"), (101, "nowhere"), (102, None), (103, "")]


@pytest.mark.parametrize("first_read,block", [(1, 40), (2, 1 << 21), (256, 300)])
def test_search_against_scores_of_all_documents(spark, odd, monkeypatch, first_read, block):
    monkeypatch.setattr(lexical, "FIRST_READ", first_read)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    assert searched(spark, odd, ITEM_ROWS) == brute.ranked(odd, ITEM_ROWS)


def test_search_in_groups_of_items_equals_one_group(spark, odd, monkeypatch):
    one = searched(spark, odd, ITEM_ROWS, k=3)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 40)
    assert searched(spark, odd, ITEM_ROWS, k=3) == one == brute.ranked(odd, ITEM_ROWS, 3)


def test_search_of_empty_tables(spark):
    some, none = [(1, "a b"), (2, None)], []
    assert searched(spark, some, none) == [] and searched(spark, none, some) == []
    assert searched(spark, [(1, None), (2, "")], some) == []


def test_block_reads_from_the_top_and_stops(monkeypatch):
    """With one clear winner the second round is not needed; with ties all are read."""
    monkeypatch.setattr(lexical, "FIRST_READ", 4)
    n = 1000
    doc = np.concatenate([np.arange(n), np.arange(n)])
    term = np.repeat([0, 1], n)
    impact = np.concatenate([np.where(np.arange(n) < 2, 100, 1), np.where(np.arange(n) < 2, 90, 1)])
    b = lexical.Block(pa.array(range(n)), doc, term, impact)
    reads = []
    monkeypatch.setattr(b, "rest", np.zeros(n, dtype=np.int64))
    part = np.partition
    monkeypatch.setattr(lexical.np, "partition", lambda a, k: reads.append(1) or part(a, k))
    assert sorted(b.search(np.array([0, 1]), np.array([1, 1]), 2, 1)) == [(0, 190), (1, 190)]
    assert len(reads) == 1
    assert len(b.search(np.array([0, 1]), np.array([1, 1]), 3, 1)) == n and len(reads) > 2


def test_words_by_bytes_equal_the_pattern():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FFF)])) for _ in range(40))
        assert [w.decode() for w in bytewords.words(t.encode())] == brute.WORD.findall(brute.ascii_lower(t))


def test_scores_equal_all_pairs_of_features():
    """The sum-of-squares identity against the double sum."""
    rng = np.random.default_rng(1)
    m = quality_model.Model(0.3, rng.normal(size=quality_model.FEATURES),
                            rng.normal(size=(quality_model.FEATURES, quality_model.FACTORS)) * 0.2)
    rows = [quality_model.featurise(t.encode(), n, quality_model.bucket_memo())
            for t, n in [("", None), ("a b c a", 7), ("### x", 0)]]
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    starts = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
    got = m.scores(index, value, starts)
    for (i, x), s in zip(rows, got):
        z = m.w0 + sum(m.w[a] * b for a, b in zip(i, x))
        z += sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_fit_learns_a_pair_that_no_single_feature_shows():
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((np.array([1 if a else 2, 3 if b else 4]), np.array([1.0, 1.0]), int(a == b)))
    m = quality_model.fit(rows, epochs=30)
    s = [m.scores(np.array([i, j]), np.ones(2), np.array([0]))[0] for i, j in [(1, 3), (2, 4), (1, 4), (2, 3)]]
    assert min(s[:2]) > 0.8 and max(s[2:]) < 0.2


def test_classifier_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in Q.queries()["op13_quality_classifier"](spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    truth = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(got[i]["predicted"], q) for i, q in truth if got[i]["held_out"]]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.95
    bad = [p for p, q in held if q == 0]
    assert sum(p == 0 for p in bad) / len(bad) > 0.8


def test_classifier_reads_no_held_out_label_and_neither_source_nor_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    assert {r["doc_id"]: r["score"] for r in quality_model.classify(other, flipped).collect()} == score


def test_classifier_edges(spark):
    rows = [(r[0], r[1], r[4]) for r in odd_rows()]
    docs = extra(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    labels = extra(spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, 0), (5, None), (None, 1), (99, 1)],
                                         "doc_id long, quality int"))
    out = quality_model.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    none = quality_model.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_training_rows_are_bounded_also_for_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}", i) for i in range(300)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert zlib.crc32(b"1") % 3 != 1
    assert quality_model.training_rows(docs, labels, "quality", "text", "doc_id", "n_chars", 20).count() == 20

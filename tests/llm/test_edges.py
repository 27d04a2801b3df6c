"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and
clashing extra columns, for every operator and pipeline stage; brute-force checks
of the inner algorithms."""

import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from tracefold.llm import (chat, html_extract, license_scan, minhash, mixing, packing, quality, sharding,  # noqa: E402
                           suffix, topk)
from tracefold.llm import queries as Q  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the house of the man is in a wood and it was an old one with a garden for all that he had " * 3).strip()


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "in", "to"]) if rng.random() < 0.3 else
                    "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    a, b = sentence(rng, 120), sentence(rng, 90)
    long = " ".join(sentence(rng, 50) for _ in range(600))
    return [
        (1, a, "en", "s1", 1), (2, a, "en", "s1", 1), (2, a, "en", "s1", 1), (3, a + " extra", "en", None, None),
        (4, None, None, None, None), (5, "", "en", "s2", 0), (6, " \n\t ", "de", "s2", 4), (None, b, "en", "s2", 9),
        (None, None, None, None, None), (7, b, "en", "s2", 9), (8, "one", "en", "s3", 3), (9, "ONE", "en", "s3", 3),
        (10, long, "en", "s3", len(long)), (11, long[:9000], "en", "s3", 9000), (12, "x " * 3000, "en", "s1", 6000),
        (13, "é" * 150 + "é" * 150, "fr", "s1", 300), (14, "Released under the MIT License.", "en", "s1", 31),
        (15, "\0 � <|endoftext|> a  b", "en", "s1", 10),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


EXTRA = ("row k t t1 t2 m w h p n x key kept all cut node comp tokens topic page part rank ordinal length piece lines at "
         "n_words base_failed component_id n_removed weight ratio band value size shard depth").split()


def extra_columns(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA) if c not in df.columns])


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_with_odd_rows_extra_columns_and_no_rows(spark, odd, empty, name, stage):
    plain = stage(spark, odd, "")
    wide = stage(spark, odd.withColumns({c: F.lit(7) for c in EXTRA}), "")
    got = plain.collect()
    if name == "best_fit_packing":
        assert wide.columns == plain.columns and len(wide.collect()) == len(got)
    else:
        assert plain.columns == odd.columns and wide.columns == [*odd.columns, *EXTRA]
        assert rows_of(wide.select(*odd.columns)) == sorted(map(str, got))
    assert stage(spark, empty, "").collect() == []


def test_quality_counts(spark, odd):
    for r in quality.quality_report(odd).collect():
        words = brute.GAP.findall(r["row"]["text"] or "")
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
        lines = [x for x in (r["row"]["text"] or "").split("\n") if brute.GAP.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (
            len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = {(r[0], r[1]): (r[2], r[3]) for r in minhash.near_duplicates(odd, width=2).collect()}
    expected = brute.near_groups(sorted({r[0]: r[1] for r in odd_rows() if r[0] is not None}.items()), 2)
    for key, (n, root) in expected.items():
        assert got[(key, n)] == (root, key == root)
    assert all(v == (None, True) for k, v in got.items() if k[0] is None)
    assert minhash.near_duplicates(empty).collect() == []


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Each text is judged by itself: its id neither links it to nor takes it away with another text of that id."""
    rng = random.Random(12)
    a, b, x, y, z = (sentence(rng, 60) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (4, x + " more"), (5, x), (5, y), (9, y + " more"), (9, y + " more"), (7, z), (7, z + " more"),
            (None, a), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r[0], r[1]): (r[2], r[3]) for r in minhash._judged(df, "text", "doc_id").join(
        df.select(minhash.text_id(F.col("text"))[0], "text").distinct(), "t1").select("k", "text", "component_id", "kept").collect()}
    once = got.pop((7, z)), got.pop((7, z + " more"))
    assert sorted(once) == [(7, False), (7, True)]
    assert got == {(1, a): (1, True), (2, a): (1, False), (2, b): (2, True), (4, x + " more"): (4, True), (5, x): (4, False),
                   (5, y): (5, True), (9, y + " more"): (5, False), (None, a): (None, True), (2, None): (2, True)}
    kept = Counter(tuple(r) for r in minhash.drop_near_duplicates(df).collect())
    assert sum(n for (i, _), n in kept.items() if i == 7) == 1
    assert {r: n for r, n in kept.items() if r[0] != 7} == {
        (1, a): 1, (2, b): 1, (4, x + " more"): 1, (5, y): 1, (None, a): 1, (2, None): 1}


def test_near_duplicate_chains_and_large_group(spark):
    """A chain whose ends are unlike, a large group of near copies and strangers."""
    rng = random.Random(8)
    words = [sentence(rng, 1) for _ in range(4000)]
    chain = [" ".join(words[10 * i:10 * i + 100]) for i in range(12)]
    base = [rng.choice(words) for _ in range(80)]
    near = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(80)] = rng.choice(words)
        near.append(" ".join(copy))
    other = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    texts = chain + near + other
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r[0]: (r[1], r[2]) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=2).collect()}
    assert got == brute.near_groups(rows, 2)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        s = minhash.sketch(a, 288)
        assert (s != np.iinfo(np.uint64).max).all() and (s == minhash.sketch(a[::-1].copy(), 288)).all()
    shared, x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    same = np.mean([(minhash.sketch(np.concatenate([shared ^ np.uint64(k), x]), 288)
                     == minhash.sketch(np.concatenate([shared ^ np.uint64(k), y]), 288)).mean() for k in range(20)])
    assert abs(same - 0.8) < 0.03


def test_substring_dedup_of_odd_rows(spark, odd, empty, monkeypatch):
    expected = sorted(map(str, brute.repeats([(r[0], r[1]) for r in odd_rows() if r[0] != 10] + [(10, "short")])))
    df = odd.withColumn("text", F.when(F.col("doc_id") == 10, "short").otherwise(F.col("text")))
    assert sorted(str(tuple(r)) for r in suffix.report(df).collect()) == expected
    assert suffix.report(empty).collect() == []


def test_runs_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    b = np.concatenate([rng.integers(97, 100, 3000, dtype=np.uint8)] * 2)
    whole = suffix.Roller().runs(b)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    cut = suffix.Roller().runs(b)

    def at(runs):
        return np.concatenate([np.full(n, v) for v, n in zip(runs[0], runs[2])])
    assert (at(whole) == at(cut)).all() and len(at(whole)) == len(b) - 199


def test_difference_cover_has_every_difference():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_repeated_suffixes_against_all_windows():
    rng = random.Random(3)
    for trial in range(25):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(200, 500))) for _ in range(3)]
        runs = [b"ab" * 150] if trial % 3 == 0 else []
        for _ in range(rng.randint(1, 12)):
            x = rng.choice(base)
            a = rng.randint(0, len(x) - 200)
            y = bytearray(x[a:rng.randint(a + 200, len(x))])
            if rng.random() < 0.5:
                y[rng.randrange(len(y))] ^= 1
            runs.append(bytes(y))
        count = Counter(r[k:k + 200] for r in runs for k in range(len(r) - 199))
        for r, flags in zip(runs, suffix.repeated_suffixes(runs)):
            assert flags.tolist() == [count[r[k:k + 200]] > 1 for k in range(len(r) - 199)]


def test_shards_fit_and_cover(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(400)] + [(7, "y" * 90)] * 40 + [(8, "z" * 5000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.assign_shards(df, limit=1000).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        assert r["oversized"] == (r["n_bytes"] > 1000) and len(r["shard"].split("-")[0]) == r["depth"]
    alone = {r["shard"] for r in got if r["oversized"]}
    assert all(n <= 1000 or s in alone for s, n in size.items()) and len(alone) == 1
    plain = sorted({r["shard"] for r in got if not r["page"]})
    assert not any(b.startswith(a) and a != b for a, b in zip(plain, plain[1:]))  # prefix-free: a directory
    assert sharding.assign_shards(odd).count() == len(odd_rows()) and sharding.assign_shards(empty).count() == 0


def mixed_rows(n=1500):
    rng = random.Random(4)
    return [(i, "the " * rng.randint(1, 40) + rng.choice(["", "\n", " | | | | | ", "license rights ", "api key: error. "]),
             rng.choice("aaabbc"), rng.choice("sssstu")) for i in range(n)]


MIX = "doc_id long, text string, lang string, source string"


def test_sample_meets_given_targets(spark):
    df = extra_columns(spark.createDataFrame(mixed_rows(), MIX))
    given = [("lang", "a", 2.0), ("lang", "b", 1.0), ("lang", "c", 1.0), ("source", "s", 0.4), ("source", "t", 0.3), ("source", "u", 0.3),
             ("lang", "nowhere", 5.0)]
    targets = spark.createDataFrame(given, "dim string, value string, share double")
    raked, goals = mixing.fit(mixing.features(df), targets, sweeps=60)
    told = {(r["dim"], r["value"]): r for r in mixing.report(raked, goals).collect()}
    assert set(told) == {g[:2] for g in given[:-1]} and all(r["met"] for r in told.values())
    assert told["lang", "a"]["target"] == pytest.approx(0.5) and told["source", "u"]["expected"] == pytest.approx(0.3, abs=1e-4)
    out = mixing.mix(df, targets, sweeps=60).collect()
    assert all(0 <= r["p"] <= 1 for r in out) and len(out) == 1500
    # the drawn documents themselves have the targets, up to the noise of the draw
    tokens = Counter()
    for r in out:
        if r["kept"]:
            tokens["lang", r["lang"]] += r["tokens"]
            tokens["source", r["source"]] += r["tokens"]
            tokens["all"] += r["tokens"]
    for k, r in told.items():
        assert tokens[k] / tokens["all"] == pytest.approx(r["target"], abs=0.03)


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = [(i, "w " * 10, "a" if i < 90 else "b", "s" if i < 90 else "t") for i in range(100)]  # languages are sources
    df = spark.createDataFrame(rows, MIX)
    targets = spark.createDataFrame([("lang", "a", 0.5), ("lang", "b", 0.5), ("source", "s", 0.9), ("source", "t", 0.1)],
                                    "dim string, value string, share double")
    raked, goals = mixing.fit(mixing.features(df), targets)
    assert not all(r["met"] for r in mixing.report(raked, goals).collect())
    assert all(0 <= r["p"] <= 1 for r in raked.collect())


def test_topics_by_words_then_register(spark):
    texts = {"The License. All rights reserved": "legal", "call or e-mail the api": "contact", "a | b | c | d": "table",
             "one\ntwo\nthree": "lines", "just some words of prose": "prose", "": "none", None: "none",
             "API key: error": "technical", "mail api": "contact"}
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], MIX)
    got = {r["key"]: r["topic"] for r in mixing.features(df).select("key", "topic").collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_default_mix_and_odd_rows(spark, odd, empty):
    df = spark.createDataFrame(mixed_rows(), MIX)
    raked, goals = mixing.fit(mixing.features(df), sweeps=40)
    assert all(r["met"] for r in mixing.report(raked, goals).collect())
    out = mixing.mix(odd).collect()
    assert len(out) == len(odd_rows()) and all(r["kept"] for r in out if not r["tokens"])
    assert mixing.mix(empty).collect() == []


def test_mixing_looks_a_word_up_once(spark):
    df = spark.createDataFrame(mixed_rows(10), MIX)
    many = {f"t{i}": f"known k{i}" for i in range(6)}
    plan = mixing.features(df, topics=many)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"filter\(x#\d+\.w, ", plan)) == 2  # the known words, and the bars of a text without any


def test_mixing_reads_the_texts_once(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.queries()["op5_mixing"](spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in out.inputFiles())  # the features were written
    whole = mixing.mix(odd).select("row.doc_id", "source", "lang", "topic", "tokens", F.round("p", 4).alias("p"), "kept")
    assert rows_of(out) == rows_of(whole) and out.count() == len(odd_rows())


def test_features_carry_the_named_columns(spark, odd):
    few = mixing.features(extra_columns(odd), carry=["k", "row"])
    assert few.select("row.*").columns == ["k", "row"]
    assert rows_of(few.drop("row")) == rows_of(mixing.features(odd).drop("row"))


def test_top_k_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-3, 3)) / 2 for _ in range(10)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 10),
                                                          (303, [float("inf")] * 10), (None, [1.0] * 10), (400, [9.0, -9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k_embeddings(df, F.col("vec_id") % 10 == 0, block=32).collect())
    import math
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q, v in ok.items():
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok.items() if c != q)
            expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:5])]
    assert got == sorted(expected)
    few = spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (2, [0.5])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k_embeddings(few, F.col("vec_id") == 0).collect()) == [
        (0, 1, 2, 32768), (0, 2, 1, -131072)]
    assert topk.top_k_embeddings(few.limit(0), F.col("vec_id") == 0).collect() == []


def test_word_coder_equals_whole_encoding():
    coder = packing.ChunkCoder(Q.tokenizer_path())
    rng = random.Random(1)
    parts = ["a", "B", "é", "1", ".", ",", "\n", " ", " ", "_", "!", "'s", "́", "\t", " ", "<|endoftext|>", "日", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["word " * 50 + "end."]
    whole = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(texts, pa.string())
    for bound in (500_000, 500_000, 20, 20):  # both generations, with and without words known
        coder.bound = bound
        assert [list(x) for x in coder.encode(column)] == whole
    assert [list(x) for x in coder.encode(column.slice(7, 900))] == whole[7:907]
    assert coder.encode(column.slice(0, 0)) == []


def test_plan_holds_every_piece_within_capacity():
    rng = random.Random(9)
    for sizes in ([], [2048] * 3, [1025] * 7, [1] * 5000, [rng.randint(1, 2048) for _ in range(3000)],
                  [700] * 100 + [648] * 100 + [100] * 30):
        counts = Counter(sizes)
        got = Counter()
        runs = packing.plan(counts)
        for lengths, n in runs:
            assert sum(lengths) <= 2048
            for x in lengths:
                got[x] += n
        assert got == counts
        least = max(-(-sum(sizes) // 2048), sum(x > 1024 for x in sizes))
        assert sum(n for _, n in runs) <= least + 1 + least // 50


def test_sequences_hold_their_ids(spark):
    texts = [(i, "word " * (i * 40)) for i in range(30)]
    cut = packing.pieces(spark.createDataFrame(texts, "doc_id long, text string"), Q.tokenizer_path(), with_ids=True)
    packed = packing.pack(cut)
    held = {r["sequence_id"]: (r["n_tokens"], bytes(r["ids"])) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        n, ids = held[r["sequence_id"]]
        assert len(ids) == 4 * n and ids[4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_extraction_of_odd_and_unseen_pages(spark):
    model = html_extract.train([])
    pages = [None, "", "<p", "no markup at all", "<div>" * 3000 + "deep", "<article><p>A &amp; B&nbsp;&#233;<br>c and so on for quite a while until it ends <p>D is next, and long too</article>",
             "<body><nav><a>x</a></nav><article><h1>Head of it</h1><p>Text of the page that is long enough to be read.</p>"
             "<div class=ad>Buy it now</div><script>var p='</p>';</script></article><footer>&copy; us</footer>"]
    got = html_extract.extract(pages, model)
    assert got[:3] == ["", "", ""] and got[5] == (
        "A & B é c and so on for quite a while until it ends\n\nD is next, and long too")
    assert got[6] == "Head of it\n\nText of the page that is long enough to be read."
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("row", F.lit(1)).withColumn(
        "text", F.lit("old"))
    out = {r["page_id"]: r["text"] for r in html_extract.main_text(df, model=model).collect()}
    assert [out[i] for i in range(len(pages))] == got
    assert html_extract.main_text(df.limit(0)).collect() == []


def test_marginals_are_exact_on_a_small_tree():
    rng = np.random.default_rng(2)
    parent = np.asarray([-1, 0, 0, 1, 1, 2, -1, 6])
    ties = rng.integers(0, 2, 8)
    unary, pair = rng.normal(size=(8, 2)), rng.normal(size=(2, 2, 2))
    weight = np.zeros(2 ** 8)
    for state in range(2 ** 8):
        y = [(state >> i) & 1 for i in range(8)]
        weight[state] = np.exp(sum(unary[i, y[i]] for i in range(8)) + sum(
            pair[ties[i], y[parent[i]], y[i]] for i in range(8) if parent[i] >= 0))
    exact = [weight[[s for s in range(2 ** 8) if (s >> i) & 1]].sum() / weight.sum() for i in range(8)]
    assert html_extract.marginals(unary, parent, ties, pair) == pytest.approx(exact)


def test_held_out_skeletons():
    """Leave one skeleton out: most of its text blocks are still judged right."""
    pages = html_extract.labelled_pages()
    wrong = total = 0
    for k, page in enumerate(pages):
        model = html_extract.train([], pages[:k] + pages[k + 1:])
        dom = html_extract.Dom.of(page)
        ev, y = html_extract.evidence(dom), html_extract.marked_labels(dom)
        c = html_extract.marginals(np.asarray(model.potentials(ev)), np.asarray(dom.parent),
                                   np.asarray([html_extract.tie(e) for e in ev]), model.pair) > 0.5
        judged = [(int(c[at]), y[at]) for at, t in dom.blocks if "".join(t).strip()]
        wrong, total = wrong + sum(a != b for a, b in judged), total + len(judged)
    assert wrong / total < 0.25


def test_license_windows_and_near_matches(spark, odd, empty):
    long = license_scan.TEMPLATES["MIT permission"]
    near = long.replace("merge", "join")  # five of its shingles change
    half = " ".join(long.split()[:15])
    rows = [(1, "word " * 37 + long + " word" * 20), (2, near.upper()), (3, half), (4, (long + " filler text here. ") * 3),
            (5, None), (6, "Released under the"), (None, "Released under the MIT License.")]
    got = {(r[0], r[1]): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT permission"), (2, "MIT permission"), (4, "MIT permission"), (None, "MIT notice")}
    assert got[1, "MIT permission"]["first_word"] == 37 and got[1, "MIT permission"]["containment"] == 1.0
    assert 0.8 <= got[2, "MIT permission"]["containment"] < 1.0
    assert [r["doc_id"] for r in license_scan.scan(odd).collect()] == [14]
    assert license_scan.scan(empty).collect() == []


def test_license_lines_shorter_than_the_shingle_width(spark):
    """Against all positions: a template of fewer than five words is found as a whole, and only then."""
    import re
    short = {"one": "Proprietary.", "two": "(c) Acme", "four": "All rights are reserved", "six": "do not copy or share this"}
    rows = [(1, "All rights reserved."), (2, "a b (C) ACME, c d proprietary e"), (3, "rights reserved all"), (4, "Acme c"),
            (5, "x " * 50 + "all rights\nARE reserved " * 3 + "do not copy or share this"), (6, ""), (7, None), (8, "proprietary")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {}
    for i, text in rows:
        w = [x for x in re.split(r"[^a-z0-9]+", (text or "").lower()) if x]
        for name, body in short.items():
            t = [x for x in re.split(r"[^a-z0-9]+", body.lower()) if x]
            at = [k for k in range(len(w) - len(t) + 1) if w[k:k + len(t)] == t]
            if at:
                expected[i, name] = at[0]
    got = license_scan.scan(df, templates=short).collect()
    assert {(r["doc_id"], r["template"]): r["first_word"] for r in got} == expected and len(got) == 5
    assert all(r["containment"] == 1.0 for r in got)
    assert [(r["doc_id"], r["template"]) for r in license_scan.scan(df).collect()] == [(1, "All rights reserved notice")]
    assert license_scan.scan(df, templates={"none": " ... "}).collect() == []


def test_quote_parsing_and_links(spark):
    own, quoted = chat.split_quotes("Hi\n\nAnn wrote:\n> Bob wrote:\n> > deep one\n> > deep two\n> top\n\nmine\n>again")
    assert own == ["Hi", "", "", "mine"]
    assert [(n, x) for _, n, x in quoted] == [(2, "deep one"), (2, "deep two"), (1, "top"), (1, "again")]
    assert len({p for p, _, _ in quoted}) == 3
    rows = [(1, 0, "user", "First line.\nSecond line"), (1, 1, "assistant", "Other words"),
            (1, 2, "user", "x wrote:\n> first LINE\n> second line!\nreply to zero"),
            (1, 3, "assistant", "> nobody said this\nhm"), (1, 4, "user", "> > First line.\n> Other words\nnested"),
            (1, 5, "user", "> zzz"), (None, None, None, None), (2, 0, "user", "First line.")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chat(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 8
    assert [got[1, t]["parent_turn"] for t in range(5)] == [None, 0, 0, 2, 1]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 1, 1, 2, 2]
    assert [got[1, t]["position"] for t in range(5)] == [0, 1, 2, 3, 4]
    assert got[1, 2]["text"] == "reply to zero" and got[1, 3]["n_linked"] == 0 and got[1, 4]["n_passages"] == 2
    assert got[None, None]["text"] == "" and got[2, 0]["parent_turn"] is None
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(none).collect() == []

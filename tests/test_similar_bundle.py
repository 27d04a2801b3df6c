"""G3, W9/J7, S5, A10/S3/S4/P17, J3, J10, J9 on literal frames and brute force."""

import datetime as dt
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tracefold.operators import bundle as B
from tracefold.operators import similar as S
from tracefold.sources import bundles as SB


def reference_hash_embedding(text: str) -> list[float]:
    """The reference's fallback embedding, restated for the check."""
    if not text:
        return [0.0] * 1536
    raw = b"".join(hashlib.sha512(f"{text}_{i}".encode()).digest() for i in range(24))
    vals = [(raw[i] + raw[i + 1] * 256) / 65535.0 * 2 - 1 for i in range(0, 1536, 2)]
    return vals + [0.0] * (1536 - len(vals))


def test_hash_embedding_matches_python(spark):
    texts = ["Root service: auth | Hint: pool", "", "é unicode ✓"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.embedding for r in S.hash_embedding(df, "t").collect()}
    for t in texts:
        assert np.allclose(got[t], reference_hash_embedding(t), atol=1e-12)


def test_top_k_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    vecs = rnd.normal(size=(60, 8)).astype(np.float32)
    vecs[7] = vecs[3]                                   # exact tie
    vecs[11] = 0                                        # zero vector is never similar
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<float>")
    got = S.top_k_similar(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "index_id"), k=5,
                          exclude_self=True, n_query_blocks=3, n_index_blocks=4)
    got = {(r.query_id, r.rank): r.index_id for r in got.collect()}
    m = vecs.astype(np.float64)
    norms = np.linalg.norm(m, axis=1)
    for q in range(60):
        if norms[q] == 0:
            assert not any(k[0] == q for k in got)
            continue
        sims = [(-(m[q] @ m[j]) / (norms[q] * norms[j]), j) for j in range(60) if j != q and norms[j] > 0]
        sims = sorted(s for s in sims if -s[0] >= 0)[:5]
        assert [got[(q, r + 1)] for r in range(len(sims))] == [j for _, j in sims]


def test_top_k_meets_every_block_and_keeps_equal_vectors_in_id_order(spark):
    """Many blocks in many partitions: every query meets every block (no pair of blocks may
    land in two tasks), and copies of a vector are equally similar wherever they stand."""
    rnd = np.random.default_rng(11)
    base = rnd.normal(size=(40, 24)).astype(np.float32)
    vecs = base[rnd.integers(0, 40, 900)]
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(vecs)] + [("none", None), ("gap", [None] * 24)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(7)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = S.top_k_similar(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "index_id"), k=4,
                              exclude_self=True, block_rows=64, n_query_blocks=5, n_index_blocks=3)
        got = {(r.query_id, r.rank): (r.index_id, r.similarity) for r in got.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    m = vecs.astype(np.float64)
    for q in range(900):
        same = [j for j in range(900) if j != q and (vecs[j] == vecs[q]).all()][:4]
        sim = np.array([np.sqrt((m[q] * m[q]).sum()) * np.sqrt((v * v).sum()) for v in m])
        rest = sorted((-round(float(m[q] @ m[j] / sim[j]), 9), j) for j in range(900) if j != q and j not in same)
        want = same + [j for s, j in rest[:4 - len(same)] if s <= 0]
        assert [got[(f"v{q:04d}", r + 1)][0] for r in range(len(want))] == [f"v{j:04d}" for j in want]
    assert len(got) == 3600


def test_upsert_last_write_wins(spark):
    v1 = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, version long, v string")
    v2 = spark.createDataFrame([("a", 2, "z")], "id string, version long, v string")
    assert sorted(map(tuple, S.upsert_incidents(v1, v2).collect())) == [("a", 2, "z"), ("b", 1, "y")]
    assert spark.range(1).select(S.learned_incident_id(F.lit("Scale Up Pool")).alias("i")).first().i == \
        "learned_scale_up_pool"


def test_bundle_json_round_trip(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    pats = spark.createDataFrame([("b1", 0, "boom", 2, t0, t0, "ERROR", "svc-7f4d9b-xkz2p")],
                                 "bundle_id string, pattern_ord long, pattern string, count long, first_ts timestamp, "
                                 "last_ts timestamp, error_class string, container string")
    win = spark.createDataFrame([("b1", t0, t0)], "bundle_id string, window_start timestamp, window_end timestamp")
    docs = SB.bundles_to_json(SB.assemble_bundles(pats, win))
    doc = docs.first().json
    assert '"use_rag":true' in doc and '"top_k":5' in doc and '"namespace"' not in doc   # empty keys dropped
    extra = spark.createDataFrame(
        [('{"id": "x", "windowStart": "a", "windowEnd": "b", "gitConfig": {}, "dependencyGraph": null, '
          '"logPatterns": [{"pattern": "p", "count": 1, "errorClass": "ERROR", "affectedService": ["s1", "s2"]}]}',),
         ("{not json",)], "json string")
    bundles, corrupt = SB.read_bundles(docs.select("json").unionByName(extra))
    assert corrupt.count() == 1
    rows = {r.id: r for r in bundles.collect()}
    assert rows["x"].git_config is None and rows["x"].dependencyGraph == []
    p = SB.explode_bundles(bundles)["patterns"].where(F.col("id") == "x").first()
    assert p.severity == "ERROR" and p.affectedService == ["s1", "s2"]
    p1 = SB.explode_bundles(bundles)["patterns"].where(F.col("id") != "x").first()
    assert p1.affectedService == ["svc"] and p1.firstOccurrence == "2024-01-01T10:00:00Z"


def test_snippets_band_join(spark):
    src = spark.createDataFrame([("repo/a/Main.java", i, f"line {i}") for i in range(1, 60)]
                                + [("repo/b/Main.java", i, f"other {i}") for i in range(1, 60)],
                                "file_path string, line_no long, text string")
    frames = spark.createDataFrame([("b", 1, "Main.java", 12), ("b", 2, "Main.java", 40), ("b", 3, "Nope.java", 3)],
                                   "bundle_id string, ord long, src_file string, src_line int")
    s = B.attach_snippets(frames, src).collect()
    assert len(s) == 1 and s[0].file_path == "repo/a/Main.java"                 # first occurrence, min path
    assert s[0].content.split("\n")[0] == "line 2" and s[0].content.split("\n")[-2] == "line 22"
    assert (s[0].start_line, s[0].end_line) == (7, 22)


def test_recent_commit_as_of(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    commits = spark.createDataFrame([("c1", t(1), "a", "m1", ["Main.java"]), ("c2", t(5), "b", "m2", ["Main.java"]),
                                     ("c3", t(9), "c", "m3", ["Main.java", "Pool.java"])],
                                    "commit_hash string, ts timestamp, author string, message string, "
                                    "changed_files array<string>")
    files = spark.createDataFrame([("b1", "Main.java", t(6)), ("b2", "Main.java", t(0)), ("b3", "Pool.java", t(9))],
                                  "bundle_id string, file string, incident_ts timestamp")
    got = {r.bundle_id: r.commit_hash for r in B.recent_commit(files, commits).collect()}
    assert got == {"b1": "c2", "b2": None, "b3": "c3"}


def test_attach_events_interval(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    bundles = spark.createDataFrame([("b1", "svc", t0, t0 + dt.timedelta(hours=3))],
                                    "bundle_id string, source_id string, window_start timestamp, window_end timestamp")
    ev = spark.createDataFrame([(f"e{i}", "svc", t0 + dt.timedelta(minutes=40 * i)) for i in range(-1, 8)]
                               + [("x", "other", t0)], "id string, service string, ts timestamp")
    got = sorted(r.id for r in B.attach_events(bundles, ev, bucket_seconds=3600).collect())
    assert got == ["e0", "e1", "e2", "e3", "e4"]

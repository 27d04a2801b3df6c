"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch.  A set of shingle hashes is thrown into ``t`` bins in rounds: in round
``i < t`` every element falls into a hashed bin, in round ``t + b`` all fall into
bin ``b``, so each coordinate fills; a bin keeps its smallest (round, hash).  A set
with many elements is done after one or two rounds, and the number of equal
coordinates of two sets concentrates around their similarity as it would for
fully random min-hashing.

Candidates.  ``BANDS`` bands of ``ROWS`` coordinates: a pair of similarity 0.8
shares no band with probability (1 - 0.8^6)^48 < 5e-7.  Copies - documents with
equal sets - are merged before banding.  A band value shared by many documents is
never expanded into pairs: every member is compared with one pivot per band value
(three rounds with other pivots) and confirmed links are merged into components.
What is left are pairs of different components that share a band value.  Their
differences to a common centre give the overlap of any two of them, so only pairs
with enough common differences are compared (``_unresolved``).  So no link between
different texts is left out, and a large group costs its size, not its square.

Verification.  Links are confirmed on the full shingle sets, computed anew from
both whole texts.

Defined results: a text that is null, empty or without words has an empty set and
is linked with nothing; fewer words than the shingle width make one shingle of the
whole sequence; rows with a null id take no part (component null, kept true);
rows that repeat an id are judged each by its own text: sets are the nodes, an id
only names a component; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import text_id, written

#: Shingle width and similarity (percent) unless the caller says otherwise.
WIDTH = 5
PERCENT = 80
BANDS = 48
ROWS = 6
#: Rounds that compare members of a band value with one pivot.
PIVOT_ROUNDS = 3
#: Words whose hashes a task remembers, at most.
_CACHE_WORDS = 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words; emptied when it reaches its bound."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def shingles(self, text: str | None, width: int) -> np.ndarray:
        """Sorted distinct hashes of the word shingles of a text."""
        if len(self) > _CACHE_WORDS:
            self.clear()
        # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=n)
        k = min(width, n)
        acc = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            acc = _mix(acc * _STEP + h[j:n - k + 1 + j])
        return np.unique(acc)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    n, i = len(elements), 0
    while i < 2 * t and (out == np.iinfo(np.uint64).max).any():
        rounds = np.arange(i, min(2 * t, i + max(1, 4096 // n)), dtype=np.uint64)
        r = _mix(elements[None, :] ^ _mix((rounds + np.uint64(1)) * _STEP)[:, None])
        bins = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)
        late = rounds >= np.uint64(t)
        if late.any():
            bins[late] = (rounds[late] - np.uint64(t))[:, None]
        # smallest (round, hash) of each bin
        np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds[:, None] << np.uint64(52)) | (r >> np.uint64(12))).ravel())
        i = int(rounds[-1]) + 1
    return out


def band_hashes(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit hashes of the bands of the sketches."""
    m = sketches.reshape(len(sketches), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[None, :], m.shape[:2]).copy()
    for j in range(rows):
        acc = _mix(acc * _STEP + m[:, :, j])
    return acc


def sketches(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, bands: int = BANDS,
             rows: int = ROWS) -> DataFrame:
    """key, t1, t2 (identity of the text), n_shingles, s1, s2 (128-bit identity of the set), bands (null if empty)."""
    t = F.col(text).cast("string")
    src = df.select(F.col(key).cast("long").alias("k"), t.alias("t"), *text_id(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                size, ident, sk, has = [], [], [], []
                for t in b.column("t"):
                    s = words.shingles(t.as_py(), width)
                    size.append(len(s))
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    ident.append(np.frombuffer(d, dtype=np.int64))
                    has.append(len(s) > 0)
                    if len(s):
                        sk.append(sketch(s, bands * rows))
                hashes = band_hashes(np.stack(sk), bands, rows).view(np.int64) if sk else np.zeros((0, bands), np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.asarray(has, dtype=np.int32) * bands)]).astype(np.int32)
                ident = np.stack(ident)
                yield pa.RecordBatch.from_arrays(
                    [b.column("k"), b.column("t1"), b.column("t2"), pa.array(size, pa.int64()), pa.array(ident[:, 0].copy()), pa.array(ident[:, 1].copy()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel()))],
                    ["k", "t1", "t2", "n_shingles", "s1", "s2", "bands"])

    return src.mapInArrow(run, "k long, t1 long, t2 long, n_shingles long, s1 long, s2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.  ``texts``
    has (node, t).  A popular ``b`` is an ordinary skewed join key, which
    adaptive execution splits; neither side is ever gathered in one group."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        last, last_set = None, None
        for b in batches:
            keep = []
            ta, tb = b.column("ta"), b.column("tb")
            for i in range(b.num_rows):
                y = tb[i].as_py()
                if y != last:
                    last, last_set = y, words.shingles(y, width)
                x = words.shingles(ta[i].as_py(), width)
                common = len(np.intersect1d(x, last_set, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(last_set) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, inter, n_b, apart): how many shingles a and b share and b has, and the
    hashes of those that only one of them has."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        last, last_set = None, None
        for b in batches:
            inter, size, apart = [], [], []
            for x, y in zip(b.column("ta"), b.column("tb")):
                y = y.as_py()
                if y != last:
                    last, last_set = y, words.shingles(y, width)
                s = words.shingles(x.as_py(), width)
                one = np.setxor1d(s, last_set, assume_unique=True)
                inter.append((len(s) + len(last_set) - len(one)) // 2)
                size.append(len(last_set))
                apart.append(one.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(inter, pa.int64()), pa.array(size, pa.int64()),
                                              pa.array(apart, pa.list_(pa.int64()))], ["a", "b", "inter", "n_b", "apart"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, inter long, n_b long, apart array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b): comp is the smallest node
    reachable.  Each round takes the smallest label among the neighbours and then
    the label of that label; every round is written, so lineage stays short."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                    .distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c")))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "c").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("comp").alias("cc"))
        new = written(step.join(jump, "c", "left").select(
            "node", F.least("c", F.coalesce("cc", "c")).alias("comp"), F.col("comp").alias("old")), "labels")
        if new.filter("comp < old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _with_components(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _unresolved(m: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a band value and can still
    be linked.

    In each band value the largest component lends a centre P (the member that
    shares most band values).  With i(x) = |x & P| and D(x) the shingles that only
    one of x and P has, two sets x, y share i(x) + i(y) - |P| + |D(x) & D(y)|
    shingles.  A set that reaches the needed overlap with P is linked to P.  Any
    other lacks at least one shingle for it, and at least as many must be common to
    D(x) and D(y) in every link of x.  So sets meet on a shingle of D that is
    early in the order of frequency, where enough others follow it, and only
    common differences from the centre bring a pair about, not the large group's
    likeness.  Nothing that could be linked is left out."""
    per = m.groupBy("band", "comp").agg(F.count("*").alias("c"))
    major = per.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("comps"),
                                    F.sum("c").alias("size")).filter("comps > 1")
    m = written(m.join(major.select("band", "major", "size"), "band"), "open-members")
    centre = (m.filter("comp = major").groupBy("major", "node").agg(F.sum("size").alias("s"))
              .groupBy("major").agg(F.max_by("node", F.struct("s", "node")).alias("p")))
    # a band value has one centre: the members meet it there, not by the component that many of them share
    m = m.join(written(major.select("band", "major").join(centre, "major").select("band", "p"), "centres"), "band")
    known = written(differences(m.select(F.col("node").alias("a"), F.col("p").alias("b")).distinct(), texts, width)
                    .withColumnsRenamed({"a": "node", "b": "p", "n_b": "np"}), "differences")

    def need(one: str, other: str) -> Column:
        """The shingles that two sets of these sizes must share."""
        return F.ceil(percent * (F.col(one) + F.col(other)) / (100 + percent))

    nodes = (m.select("node", "n", "comp", "major", "p").distinct().join(known, ["node", "p"])
             .withColumn("lack", need("n", "np") - F.col("inter")))
    centred = nodes.filter("comp != major and lack <= 0").select(F.col("node").alias("a"), F.col("p").alias("b"))
    # what is linked to P counts as P's component from here
    nodes = nodes.select("node", "p", "n", "inter", "np", "apart", F.expr("if(lack <= 0, major, comp)").alias("comp"), "major",
                         F.greatest("lack", F.lit(1)).alias("lack"))
    each = written(nodes.filter(F.size("apart") >= F.col("lack")).withColumn("x", F.explode("apart")).drop("apart"), "apart")
    several = each.groupBy("p", "x").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    own = Window.partitionBy("node", "p")
    each = (each.join(several.select("p", "x", "f"), ["p", "x"])
            .withColumn("room", F.count("*").over(own) - F.row_number().over(own.orderBy("f", "x")) + 1).filter("room >= lack"))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("p", "x", *[F.col(c).alias(k + x) for c, k in (("node", ""), ("n", "n"), ("comp", "c"), ("inter", "i"), ("room", "r"))],
                         *([F.col("major"), F.col("np")] if x == "a" else []))

    # different components, one of them not the largest; each pair once
    wanted = need("na", "nb") + F.col("np") - F.col("ia") - F.col("ib")
    likely = (side(each.filter("comp != major"), "a").join(side(each, "b"), ["p", "x"])
              .filter((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b"))))
              .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).filter(F.least("ra", "rb") >= wanted))
    both = likely.select("a", "b", "p", wanted.alias("wanted")).distinct()
    for x in "ab":
        both = both.join(known.select(F.col("node").alias(x), "p", F.col("apart").alias("d" + x)), [x, "p"])
    apart = both.filter(F.size(F.array_intersect("da", "db")) >= F.col("wanted")).select("a", "b")
    return centred.unionByName(apart).distinct()


def _judged(df: DataFrame, text: str, key: str, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS,
            rows: int = ROWS) -> DataFrame:
    """One row per input row: k, t1, t2, n_shingles, component_id, kept."""
    sk = written(sketches(df, text, key, width, bands, rows), "sketches")
    sets = written(sk.filter("n_shingles > 0 and k is not null").groupBy("s1", "s2").agg(
        F.min("k").alias("label"), F.min(F.struct("t1", "t2")).alias("sample"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "sets")
    values = sets.select("node", "n", F.explode("bands").alias("band"))
    shared = values.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    members = written(values.join(shared.select("band"), "band"), "members")
    wanted = members.select("node").distinct()
    samples = sets.join(wanted, "node").select("node", "sample.*")
    t = F.col(text).cast("string")
    texts = written(df.select(*text_id(t), t.alias("t")).groupBy("t1", "t2").agg(F.first("t").alias("t"))
                    .join(samples, ["t1", "t2"]).select("node", "t"), "texts")
    confirmed, comps, tried = None, None, None
    for turn in range(PIVOT_ROUNDS):
        m = _with_components(members, comps)
        order = F.struct(F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), F.col("node")), F.col("node"))
        pivots = m.groupBy("band").agg(F.min_by(F.struct("node", "n", "comp"), order).alias("p"),
                                       F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        pairs = (m.join(pivots.select("band", "p"), "band").filter(F.col("comp") != F.col("p.comp"))
                 .filter(F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent)
                 .select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct())
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = written(verified(pairs, texts, width, percent), "confirmed")
        confirmed = good if confirmed is None else confirmed.unionByName(good)
        comps = components(confirmed)
    pairs = _unresolved(_with_components(members, comps), texts, width, percent)
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti").join(
            tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    pairs = written(pairs, "pairs")
    if not pairs.isEmpty():
        good = written(verified(pairs, texts, width, percent), "confirmed")
        confirmed = good if confirmed is None else confirmed.unionByName(good)
        comps = components(confirmed)
    # a component is named by its smallest id; of the sets of that id, one is the first
    own = F.struct("label", "s1", "s2")
    sets = sets.select("s1", "s2", "node", own.alias("own"))
    if comps is not None:
        firsts = sets.join(comps, "node").groupBy("comp").agg(F.min("own").alias("first"))
        sets = sets.join(comps.join(firsts, "comp").select("node", "first"), "node", "left").select(
            "s1", "s2", F.coalesce("first", "own").alias("first"))
    else:
        sets = sets.withColumnRenamed("own", "first")
    out = sk.join(sets.select("s1", "s2", "first"), ["s1", "s2"], "left")
    comp = F.when(F.col("n_shingles") == 0, F.col("k")).otherwise(F.when(F.col("k").isNotNull(), F.col("first.label")))
    kept = (F.col("n_shingles") == 0) | (F.struct(F.col("k").alias("label"), "s1", "s2") == F.col("first"))
    return out.select("k", "t1", "t2", "n_shingles", comp.alias("component_id"),
                      (F.col("k").isNull() | F.coalesce(kept, F.lit(True))).alias("kept"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per input row: ``key``, n_shingles, component_id, kept."""
    return _judged(df, text, key, **options).select(F.col("k").alias(key), "n_shingles", "component_id", "kept")


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose document is the first of its group, with their own
    columns.  Rows repeating a kept (id, text) are that same document and stay."""
    gone = _judged(df, text, key, **options).filter("not kept").select("k", "t1", "t2").distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("k"), *text_id(F.col(text).cast("string")))
    return rows.join(gone, ["k", "t1", "t2"], "left_anti").select("row.*")

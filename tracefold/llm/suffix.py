"""Exact substring dedup: difference-cover blockwise suffix construction.

Every byte covered by a 200-byte string that starts twice or more in the corpus
is removed.  Only suffixes' first 200 bytes matter, so all suffixes of the corpus
are dealt into *suffix buckets* such that equal 200-byte prefixes share a bucket:
the bucket of a position is the smallest 64-byte rolling hash inside its 200-byte
prefix.  Neighbouring positions mostly share their bucket, so a bucket receives
runs (the covered bytes of some 70 suffixes at once), not single suffixes.

1. Texts are hashed (128 bits); copies count as occurrences but are read once.
2. Bucket values that occur in one run of one text only are dropped: no suffix in
   them can repeat.  This leaves the runs of texts with shared passages.
3. Buckets are sorted one block at a time, within a bound on bytes.  In a block
   the suffixes are compared by their first bytes, and the long ties - copies
   with hundreds of equal bytes - are resolved by precomputed ranks of a
   difference-cover sample: positions p with p mod 13 in {0, 1, 3, 9} are ranked
   at depth 182 by doubling over the sample alone.  For any two suffixes i, j there
   is an offset d < 13 at which both i+d and j+d are in the sample; equal first 16
   bytes, equal rank at d and equal last 24 bytes mean 200 equal bytes.  So a
   suffix repeats if and only if one of its four (first, rank, last, d) keys is
   shared.  All comparisons are on the bytes themselves, no hash decides.
4. Identical runs of many texts are merged before the sort and answered by join,
   so a passage shared by any number of texts is sorted once.

Defined results: a null text is empty (0 bytes); texts under 200 bytes lose
nothing; a text of 200 bytes or more that occurs twice loses every byte; ids may
be null or repeat, each row is judged as a text of its own; empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import text_id, written

LENGTH = 200
GRAM = 64
#: Perfect difference cover: every residue difference mod 13 occurs once.
PERIOD = 13
COVER = (0, 1, 3, 9)
DEPTH = 182           # 14 periods; first 16 + rank + last 24 bytes cover 200 for any offset < 13
RUN = 256             # positions in one run at most
BLOCK_BYTES = 4 << 20  # suffix buckets sorted at once
PLACE = np.uint64((1 << 20) - 1)
CHUNK = (1 << 20) - 512  # positions hashed at once; a place in them fits PLACE

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Roller:
    """Smallest gram hash in the prefix of each position of a text."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 2 * len(self.power))
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                a = np.full(n, np.uint64(base), dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def buckets(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start of a ``length``-byte string in ``b`` its bucket value and
        the place of the gram that gave it (the leftmost of equals)."""
        n, k, w = len(b), self.gram, self.width
        self._powers(n + 1)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[b] * self.power[:n], out=s[1:])
        h = (s[k:] - s[:-k]) * self.inverse[:n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        m = len(h)
        blocks = -(-m // w)
        pad = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        pad[:m] = (h & ~PLACE) | np.arange(m, dtype=np.uint64)
        grid = pad.reshape(blocks, w)
        up = np.minimum.accumulate(grid, axis=1).ravel()
        down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(down[:m - w + 1], up[w - 1:m]) & PLACE).astype(np.int64)
        return h[place], place

    def runs(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, first position, positions, inner) of the runs of a text; only
        a run that is ``inner`` - its bucket value stands at two places - can hold
        two equal strings."""
        out = []
        for at in range(0, max(0, len(b) - self.length + 1), CHUNK):
            v, place = self.buckets(b[at:at + CHUNK + self.length - 1])
            starts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
            ends = np.append(starts[1:], len(v))
            out.append((v[starts], starts + at, ends - starts, place[starts] != place[ends - 1]))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _array(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def bucket_values(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(m, t1, t2, u): a row per bucket value of a text.  ``u`` is the text's
    hash; a value with two runs in the text has a second row with another u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(length, gram)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                t1, t2 = _array(b.column("t1")), _array(b.column("t2"))
                ms, rows, us = [], [], []
                for i, t in enumerate(b.column("t")):
                    v, _, _, inner = roller.runs(_bytes(t.as_py()))
                    if not len(v):
                        continue
                    values, counts = np.unique(v, return_counts=True)
                    twice = np.union1d(values[counts > 1], v[inner])
                    ms += [values, twice]
                    rows.append(np.full(len(values) + len(twice), i))
                    us += [np.full(len(values), t1[i]), np.full(len(twice), ~t1[i])]
                if ms:
                    r = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(ms).view(np.int64)), pa.array(t1[r]), pa.array(t2[r]),
                         pa.array(np.concatenate(us))], ["m", "t1", "t2", "u"])

    return texts.mapInArrow(run, "m long, t1 long, t2 long, u long")


def run_rows(texts: DataFrame, length: int, gram: int, with_bytes: bool) -> DataFrame:
    """Runs of the texts whose bucket value is in the text's list ``ms``: either
    the bytes they cover (m, hc, covered, inner) or where they are (m, hc, t1, t2, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(length, gram)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = {k: [] for k in ("m", "hc", "covered", "inner", "t1", "t2", "base")}
                t1, t2 = _array(b.column("t1")), _array(b.column("t2"))
                for i, (t, want) in enumerate(zip(b.column("t"), b.column("ms"))):
                    raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                    v, first, n, inner = roller.runs(np.frombuffer(raw, dtype=np.uint8))
                    shared = np.isin(v, np.asarray(want.values).view(np.uint64))
                    for m, p, c, twice in zip(v[shared].view(np.int64).tolist(), first[shared].tolist(),
                                              n[shared].tolist(), inner[shared].tolist()):
                        for s in range(p, p + c, RUN):
                            x = raw[s:min(s + RUN, p + c) + length - 1]
                            out["m"].append(m)
                            out["hc"].append(xxhash.xxh3_64_intdigest(x) - (1 << 63))
                            if with_bytes:
                                out["covered"].append(x)
                                out["inner"].append(twice)
                            else:
                                out["t1"].append(t1[i])
                                out["t2"].append(t2[i])
                                out["base"].append(s)
                names = ["m", "hc"] + (["covered", "inner"] if with_bytes else ["t1", "t2", "base"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[k], {"covered": pa.binary(), "inner": pa.bool_()}.get(k, pa.int64())) for k in names], names)

    return texts.select("t1", "t2", "t", "ms").mapInArrow(
        run, "m long, hc long, covered binary, inner boolean" if with_bytes else "m long, hc long, t1 long, t2 long, base long")


# ------------------------------------------------------------------ one block of suffix buckets

def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, equal rows alike."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)[1]


def cover_ranks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sample positions of ``text`` (those with DEPTH bytes after them) and their
    ranks at that depth, by doubling over the sample alone."""
    periods = -(-len(text) // PERIOD)
    sample = (np.arange(periods)[:, None] * PERIOD + np.asarray(COVER)[None, :]).ravel()
    padded = text + bytes(2 * DEPTH)
    word = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    rank = _names(word[sample], word[sample + PERIOD - 8])
    step, each = 1, len(COVER)

    def shifted(r: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([r[by * each:], np.full(min(by * each, len(r)), -1, dtype=r.dtype)])[:len(r)] + 1

    while 2 * step * PERIOD <= DEPTH:
        rank = _pair(rank + 1, shifted(rank, step))
        step *= 2
    rank = _pair(rank + 1, shifted(rank, DEPTH // PERIOD - step))
    return sample, rank


def repeated_suffixes(covered: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each run, which of its positions start a ``length``-byte string that
    also starts elsewhere among these runs."""
    text = b"".join(covered)
    sizes = np.asarray([len(c) for c in covered])
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    count = sizes - length + 1
    at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    sample, rank = cover_ranks(text)
    del sample
    padded = text + bytes(8)
    word = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    # a first cheap split: suffixes whose first and last bytes occur once are unique
    ends = _names(word[at], word[at + 8], word[at + length - 8], word[at + length - 16], word[at + length - 24])
    size = np.bincount(ends)
    tied = np.flatnonzero(size[ends] > 1)
    again = np.zeros(len(at), dtype=bool)
    residue = at[tied] % PERIOD
    keys, owner = [], []
    for d in range(PERIOD):
        hit = np.flatnonzero(np.isin((residue + d) % PERIOD, COVER))
        p = at[tied[hit]] + d
        slot = (p // PERIOD) * len(COVER) + np.searchsorted(COVER, p % PERIOD)
        keys.append(np.stack([ends[tied[hit]], rank[slot] * PERIOD + d]))
        owner.append(tied[hit])
    if len(tied):
        keys, owner = np.concatenate(keys, axis=1), np.concatenate(owner)
        key = (keys[0] << 36) | keys[1] if keys[1].max() < (1 << 36) and keys[0].max() < (1 << 27) else _names(*keys)
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        both = np.zeros(len(k), dtype=bool)
        both[1:] |= same
        both[:-1] |= same
        again[owner[order[both]]] = True
    return np.split(again, np.cumsum(count)[:-1])


def _spans(flags: np.ndarray) -> list[int]:
    """first, last, first, last, ... of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return np.column_stack([edge[::2], edge[1::2] - 1]).ravel().tolist()


def sorted_blocks(runs: DataFrame, length: int) -> DataFrame:
    """(m, hc, spans) of distinct runs (m, hc, covered, inner, n): the positions that
    repeat.  A partition is a range of suffix buckets in order of ``m``; blocks of
    whole buckets are sorted one after the other."""

    def answer(block: list[tuple[int, int, bytes, int, bool]], hard: list[int]) -> pa.RecordBatch:
        spans: dict[int, list[int]] = {}
        if hard:
            for i, flags in zip(hard, repeated_suffixes([block[i][2] for i in hard], length)):
                if flags.any():
                    spans[i] = _spans(flags)
        for i, (_, _, x, n, _) in enumerate(block):
            if n > 1:
                spans[i] = [0, len(x) - length]
        rows = sorted(spans)
        return pa.RecordBatch.from_arrays(
            [pa.array([block[i][0] for i in rows], pa.int64()), pa.array([block[i][1] for i in rows], pa.int64()),
             pa.array([spans[i] for i in rows], pa.list_(pa.int64()))], ["m", "hc", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hard, size, first = [], [], 0, 0

        def close() -> None:
            # the bucket that ends here: one run alone, without equal strings in it, needs no sort
            members = range(first, len(block))
            if len(members) > 1 or block[first][4]:
                hard.extend(members)

        for b in batches:
            for m, hc, x, n, inner in zip(_array(b.column("m")).tolist(), _array(b.column("hc")).tolist(),
                                          b.column("covered").to_pylist(), _array(b.column("n")).tolist(),
                                          b.column("inner").to_pylist()):
                if block and block[-1][0] != m:
                    close()
                    first = len(block)
                    if size >= BLOCK_BYTES:
                        yield answer(block, hard)
                        block, hard, size, first = [], [], 0, 0
                block.append((m, hc, x, n, inner))
                size += len(x)
        if block:
            close()
            yield answer(block, hard)

    return (runs.repartition("m").sortWithinPartitions("m")
            .mapInArrow(run, "m long, hc long, spans array<long>"))


def cover(n: int, spans: list[dict], length: int) -> np.ndarray:
    """Bytes of a text that the strings starting in the spans cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        edge[s["s"]] += 1
        edge[min(n, s["e"] + length)] -= 1
    return np.cumsum(edge[:n]) > 0


def removed(texts: DataFrame, length: int) -> DataFrame:
    """(t1, t2, n_removed, n_spans, kept_sha256, kept) of texts with their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                gone, spans, sha, kept = [], [], [], []
                for t, s in zip(b.column("t"), b.column("at")):
                    raw = _bytes(t.as_py())
                    c = cover(len(raw), s.as_py(), length)
                    rest = raw[~c].tobytes()
                    gone.append(int(c.sum()))
                    spans.append(int((np.diff(np.concatenate([[0], c.astype(np.int8)])) == 1).sum()))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("t1"), b.column("t2"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                    ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("t1", "t2", "t", "at").mapInArrow(
        run, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept string")


def repeated_spans(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(copies, partly): (t1, t2) of the texts that occur more than once, and
    (t1, t2, n_removed, n_spans, kept_sha256, kept) of texts that lose a part.

    ``length`` is LENGTH but for tests of the run and bucket logic; the
    difference-cover depth belongs to LENGTH."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = df.select(*text_id(t), t.alias("t")).filter(F.octet_length("t") >= length)
    values = written(bucket_values(texts, length, gram), "bucket-values")
    shared = values.groupBy("m").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).filter("lo < hi").select("m")
    wanted = values.select("m", "t1", "t2").join(shared, "m").groupBy("t1", "t2").agg(F.collect_set("m").alias("ms"))
    once = texts.groupBy("t1", "t2").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    some = written(once.join(wanted, ["t1", "t2"]), "shared-texts")
    distinct = run_rows(some, length, gram, True).groupBy("m", "hc").agg(F.first("covered").alias("covered"),
                                                                        F.max("inner").alias("inner"),
                                                                        F.count("*").alias("n"))
    spans = written(sorted_blocks(distinct, length), "spans")
    found = (run_rows(some.filter("copies = 1"), length, gram, False).join(spans, ["m", "hc"])
             .select("t1", "t2", F.explode(F.transform(
                 F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1),
                 lambda i: F.struct((F.col("base") + F.get("spans", i * 2)).alias("s"),
                                    (F.col("base") + F.get("spans", i * 2 + 1)).alias("e")))).alias("x"))
             .groupBy("t1", "t2").agg(F.collect_list("x").alias("at")))
    partly = written(removed(some.filter("copies = 1").join(found, ["t1", "t2"]), length), "partly")
    copies = written(texts.groupBy("t1", "t2").count().filter("count > 1").select("t1", "t2"), "copies")
    return copies, partly


def report(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    copies, partly = repeated_spans(df, text, length)
    rows = df.select(F.col(key).alias("k"), *text_id(t), F.octet_length(t).cast("long").alias("n_bytes"),
                     F.sha2(t, 256).alias("sha"))
    rows = (rows.join(copies.withColumn("all", F.lit(True)), ["t1", "t2"], "left")
            .join(partly.drop("kept"), ["t1", "t2"], "left"))
    return rows.select(
        F.col("k").alias(key), "n_bytes", F.when(F.col("all"), F.col("n_bytes")).otherwise(
            F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("all"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("all"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def strip_repeats(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with every repeated byte cut from its text.  A character that a cut
    leaves in halves is dropped; a null text stays null."""
    copies, partly = repeated_spans(df, text, length)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), *text_id(t))
    rows = rows.join(copies.withColumn("all", F.lit(True)), ["t1", "t2"], "left").join(
        partly.select("t1", "t2", "kept"), ["t1", "t2"], "left")
    own = F.col(f"row.{text}")
    new = F.when(F.col("all"), F.lit("")).otherwise(F.coalesce("kept", own))
    return rows.select(F.col("row").withField(text, new).alias("row")).select("row.*")

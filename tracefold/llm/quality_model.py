"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are

* its lower-cased words, hashed into ``WORD_BUCKETS`` buckets, with the value
  sqrt(count), the word part scaled to length one;
* structure statistics of the whole text (share of symbols, capitals, digits,
  repeated lines, repeated neighbours, distinct words, ...), each as steps: all
  bins up to its own one are set, so that neighbouring values are alike;
* metadata: the bin of the stored number of characters (null is a bin of its own).

Label, language, source and id are never among them.  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

which costs time linear in the features (the sum-of-squares identity).

The model is fitted on a bounded sample: the ``TRAIN_ROWS`` labelled rows with
the smallest hash of their id, taken alike at every size, at most
``TRAIN_ROWS * FEATURES`` numbers.  Its ``FEATURES * (FACTORS + 1)`` weights are
fixed in number and go to the tasks; scoring is one scan without a shuffle.

Defined results: null and empty texts get the score of the empty text; rows are
scored one by one, so repeated ids or rows each have a score (equal text and
character count: equal score); labels that are null are left out, an id with
several labels or texts gives an example for each; without any labelled row the
score is 0.5 everywhere.  A null id is never held out.  An empty table gives no
rows.  Very long texts are read whole.  Only the id, the text and the character
count are read, so no extra column can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.bytewords import Memo, raw, slices, words

WORD_BUCKETS = 1 << 12
BINS = 16
#: value of a set bin
STEP = 0.5
FACTORS = 8
#: labelled rows that the model is fitted on at most
TRAIN_ROWS = 6000
EPOCHS = 12
BATCH = 64
RATE = 0.1
SEED = 2024
#: rows with this remainder of crc32(id) modulo ``FOLDS`` are held out
FOLDS = 3
HELD_OUT = 1

_SYMBOLS = b"#*$%&|<>{}[]=+~^_\\/@"
_MARKS = b"!?"
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_STATS = ("words", "word_length", "symbols", "marks", "capitals", "digits", "lines", "repeated_lines", "neighbours",
          "distinct", "longest_run", "most_frequent")
META = WORD_BUCKETS + BINS * len(_STATS)
FEATURES = META + BINS


def _count(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(x).bit_length())


def _share_bin(part: float, whole: float) -> int:
    """0 for none, then by halves: over 1/2, 1/4, ... of the whole get high bins."""
    if not part or not whole:
        return 0
    return max(1, min(BINS - 1, BINS - int(whole / part).bit_length()))


def structure(text: bytes, ws: list[bytes], counts: Counter) -> list[int]:
    """One bin per statistic of ``_STATS``."""
    n, size = len(ws), len(text)
    letters = _count(text, _SMALL) + _count(text, _CAPITALS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = list(map(eq, ws, islice(ws, 1, None)))
    equal = sum(same)
    longest = max((len(list(g)) for x, g in groupby(same) if x), default=0) if equal else 0
    return [
        _log_bin(n), min(BINS - 1, sum(map(len, ws)) // n) if n else 0, _share_bin(_count(text, _SYMBOLS), size),
        _share_bin(_count(text, _MARKS), size), _share_bin(_count(text, _CAPITALS), letters),
        _share_bin(_count(text, _DIGITS), size), _log_bin(len(lines)), _share_bin(len(lines) - len(set(lines)), len(lines)),
        _share_bin(equal, n), min(BINS - 1, len(counts) * BINS // n) if n else 0, _log_bin(longest),
        _share_bin(max(counts.values(), default=0), n)]


def bucket_memo() -> Memo:
    return Memo(lambda w: crc32(w) % WORD_BUCKETS)


def featurise(text: bytes, n_chars: int | None, bucket: Memo) -> tuple[list[int], list[float]]:
    """Indices (distinct) and values of a text's features."""
    ws = words(text)
    counts = Counter(ws)
    hashed: Counter = Counter()
    for w, n in counts.items():
        hashed[bucket[w]] += n
    scale = 1 / max(1, len(ws)) ** 0.5  # sqrt(count) has length sqrt(words)
    index, value = list(hashed), [n ** 0.5 * scale for n in hashed.values()]
    for j, b in enumerate(structure(text, ws, counts)):
        index.extend(range(WORD_BUCKETS + j * BINS, WORD_BUCKETS + j * BINS + b + 1))
        value.extend([STEP] * (b + 1))
    index.append(META + (0 if n_chars is None else 1 + min(BINS - 2, max(0, int(n_chars)).bit_length())))
    value.append(STEP)
    return index, value


class Model:
    """Weights ``w0``, ``w`` (features) and ``v`` (features, factors)."""

    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.w0 = w0
        self.w = np.zeros(FEATURES) if w is None else w
        self.v = np.zeros((FEATURES, FACTORS)) if v is None else v

    def parts(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the factor sums of rows that begin at ``starts`` (none is empty)."""
        xv = self.v[index] * value[:, None]
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[index] * value, starts)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return sigmoid(self.parts(index, value, starts)[0])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE,
        seed: int = SEED) -> Model:
    """Log loss by AdaGrad in small batches, in an order that only the seed decides."""
    rng = np.random.default_rng(seed)
    m = Model(v=rng.normal(0, 0.05, (FEATURES, FACTORS)))
    if not rows:
        return Model()
    share = min(max(sum(y for _, _, y in rows) / len(rows), 0.01), 0.99)
    m.w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(FEATURES, 1e-8), np.full((FEATURES, FACTORS), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at:at + BATCH]]
            index = np.concatenate([p[0] for p in part])
            value = np.concatenate([p[1] for p in part])
            sizes = np.array([len(p[0]) for p in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z, sums = m.parts(index, value, starts)
            err = (sigmoid(z) - np.array([p[2] for p in part])) / len(part)
            e = np.repeat(err, sizes) * value
            dv = e[:, None] * (np.repeat(sums, sizes, axis=0) - m.v[index] * value[:, None])
            used, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, e, minlength=len(used))
            dv = np.stack([np.bincount(where, dv[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1)
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += float(err.sum()) ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * float(err.sum()) / g0 ** 0.5
    return m


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, n_chars: str,
                  bound: int) -> DataFrame:
    """(index, value, y) of at most ``bound`` labelled rows that are not held out."""
    chosen = labels.select(F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k"))).distinct().orderBy(
        F.md5("k"), "k", "y").limit(bound)
    found = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"),
                        F.col(n_chars).cast("long").alias("n")).join(F.broadcast(chosen), "k")  # at most ``bound`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = bucket_memo()
        for b in slices(batches):
            both = [featurise(t, n, bucket) for t, n in zip(raw(b.column("t")), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array([i for i, _ in both], pa.list_(pa.int32())),
                 pa.array([v for _, v in both], pa.list_(pa.float32())), b.column("y")], ["k", "index", "value", "y"])

    made = found.select("k", "t", "n", "y").mapInArrow(run, "k string, index array<int>, value array<float>, y int")
    return made.orderBy(F.md5("k"), "k", "y", F.xxhash64("index", "value")).limit(bound).select("index", "value", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
          n_chars: str = "n_chars", bound: int = TRAIN_ROWS) -> Model:
    rows = training_rows(docs, labels, label, text, key, n_chars, bound).toArrow().to_batches()
    sample = [(np.asarray(i.values), np.asarray(v.values, dtype=np.float64), y) for b in rows
              for i, v, y in zip(b.column("index"), b.column("value"), b.column("y").to_pylist())]
    return fit(sample)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """``key``, held_out, score, predicted of every row."""
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(n_chars).cast("long").alias("n"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = bucket_memo()
        for b in slices(batches):
            index, value, starts = [], [], []
            for t, n in zip(raw(b.column("t")), b.column("n").to_pylist()):
                i, v = featurise(t, n, bucket)
                starts.append(len(index))
                index.extend(i)
                value.extend(v)
            s = model.scores(np.array(index), np.array(value, dtype=np.float32).astype(np.float64), np.array(starts))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(s, pa.float64())], ["k", "score"])

    return src.mapInArrow(run, f"k {kind}, score double").select(
        F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
             n_chars: str = "n_chars", bound: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled rows that are not held out, score every row."""
    return score(docs, train(docs, labels, label, text, key, n_chars, bound), text, key, n_chars)

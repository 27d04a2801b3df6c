"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are dealt to ``SLICES`` slices; the partial inner products of
one slice over one block of rows are a *local score list*, and a score is the sum
of a row's entries in the lists of all slices.

1. Every local list gives its k best entries per query.  The exact scores of
   these rows give tau, the k-th best: no row below tau can be in the answer.
2. The cutoff tau / SLICES is sent to all lists, and each returns every entry at
   or above it.  A row with a score of tau or more has such an entry in at least
   one slice, so the returned entries are sufficient.
3. A returned row whose known entries plus the cutoff for its unknown ones stay
   below tau is dropped; the scores of the others are resolved exactly and ranked.

Blocks of queries meet blocks of rows in tasks of bounded size; only entries
leave a task, never a score matrix.  Of the rows with equal vectors at most k of
an id are kept, and of these the 2 k with the smallest ids: whichever id a query
leaves out as its own, the k smallest others are among them.  A very common
vector so costs no more than any.

Defined results: vectors that are null or hold null or non-finite components, and
rows with a null id, take no part; shorter vectors count as filled up with zeros;
a query row never meets rows of its own id; query rows repeating an id are each
answered; fewer candidates than k give them all, equal scores go by the smaller
id; ids keep their type; only id and vector are read, so no extra column can
clash; empty in, empty out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import written

K = 5
#: More lists mean a lower cutoff for each and many more entries above it.
SLICES = 2
BLOCK = 4096
#: Integer scale of the components.
SCALE = 256


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Integer components; null where the vector takes no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(vector.isNotNull() & F.coalesce(ok, F.lit(False)), ints)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _numbers(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal integers for equal ids, whatever their type."""
    if pa.types.is_integer(a.type):
        return a.to_numpy(), b.to_numpy()
    codes = pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    return codes[:len(a)], codes[len(a):]


def _partials(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point where it is exact, as it is faster."""
    top = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(v).max(initial=0))) * q.shape[1]
    if top < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _meet(queries: DataFrame, rows: DataFrame, entries, width: int):
    """Run ``entries(partials, cutoffs, same id) -> (query index, row index)`` on the
    local list of every (row block, query block, slice)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["q", "r", "slice", "part"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        part = _partials(_matrix(left["v"], width), _matrix(right["v"], width))
        mine, theirs = _numbers(left["id"], right["id"])
        own = mine[:, None] == theirs[None, :]
        tau = left["tau"].to_numpy() if "tau" in left.column_names else None
        i, j = entries(part, tau, own)
        return pa.table({"q": pa.array(left["q"].to_numpy()[i]), "r": pa.array(right["r"].to_numpy()[j]),
                         "slice": pa.array(np.full(len(i), left["slice"][0].as_py(), dtype=np.int32)),
                         "part": pa.array(part[i, j])})

    keys = ("rb", "qb", "slice")
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, "q long, r long, slice int, part long")


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, slices: int = SLICES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` and ``rows`` given as
    (id, v array<long>); ids of any orderable type."""
    q = written(queries.filter("id is not null and v is not null").withColumn("q", F.monotonically_increasing_id()), "topk-q")
    of_id = F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))
    few = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    r = rows.filter("id is not null and v is not null").withColumn("n", of_id).filter(F.col("n") <= k)
    r = r.withColumn("n", few).filter(F.col("n") <= 2 * k).drop("n")
    r = written(r.withColumn("r", F.monotonically_increasing_id()), "topk-r")
    n_q, dim_q = q.agg(F.count("*"), F.max(F.size("v"))).first()
    n_r, dim_r = r.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, -(-max(dim_q or 0, dim_r or 0) // slices))
    blocks_q, blocks_r = max(1, -(-n_q // block)), max(1, -(-n_r // block))

    def sliced(df: DataFrame, own: str, n_own: int, other: str, n_other: int, key: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)),
                          lambda s: F.struct(s.alias("slice"), F.slice("v", s * width + 1, width).alias("v")))
        return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
                .withColumn("cut", F.explode(cut)).withColumn("slice", F.col("cut.slice"))
                .withColumn("v", F.col("cut.v")).drop("cut")
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    left = sliced(q, "qb", blocks_q, "rb", blocks_r, "q")
    right = sliced(r, "rb", blocks_r, "qb", blocks_q, "r")

    def best(part: np.ndarray, tau, own: np.ndarray):
        lists = np.where(own, np.iinfo(np.int64).min, part)
        n = min(k, lists.shape[1])
        j = np.argpartition(-lists.astype(np.float64), n - 1, axis=1)[:, :n].ravel()
        i = np.repeat(np.arange(len(lists)), n)
        keep = ~own[i, j]
        return i[keep], j[keep]

    def enough(part: np.ndarray, tau: np.ndarray, own: np.ndarray):
        return np.nonzero((part * slices >= tau[:, None]) & ~own)

    def exact(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(r.select("r", F.col("id").alias("vec_id"), F.col("v").alias("rv")), "r")
                .join(q.select("q", F.col("id").alias("query_id"), F.col("v").alias("qv")), "q"))
        zero = F.lit(0).cast("long")
        score = F.aggregate(F.zip_with("qv", "rv", lambda a, b: F.coalesce(a * b, zero)), zero, lambda s, x: s + x)
        return both.select("q", "query_id", "vec_id", score.alias("score"))

    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id"))
    # phase 1: the best entries of every list, then of every slice; tau from their exact scores
    lists = _meet(left, right, best, width)
    top = F.row_number().over(Window.partitionBy("q", "slice").orderBy(F.col("part").desc(), F.col("r")))
    seen = exact(lists.withColumn("n", top).filter(F.col("n") <= k).select("q", "r").distinct())
    kth = (seen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("q")
           .agg(F.min("score").alias("tau"), F.count("*").alias("n")))
    # with fewer than k candidates in all, every row is wanted: the lowest cutoff
    low = -(1 << 60)
    tau = written(kth.select("q", F.when(F.col("n") >= k, F.col("tau")).otherwise(F.lit(low)).alias("tau")), "topk-tau")
    # phase 2: all entries at or above tau / slices
    left = left.join(tau, "q")
    found = _meet(left, right, enough, width).groupBy("q", "r").agg(F.sum("part").alias("known"),
                                                                    F.count("*").alias("lists"))
    # phase 3: rows that can still reach tau, resolved exactly
    unseen = F.ceil(F.col("tau") / F.lit(slices)) - 1
    able = (found.join(tau, "q").filter(F.col("known") + (F.lit(slices) - F.col("lists")) * unseen >= F.col("tau"))
            .select("q", "r"))
    return (exact(able).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def top_k_embeddings(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding",
                     k: int = K, **options) -> DataFrame:
    v = df.select(F.col(key).alias("id"), scaled(F.col(vector)).alias("v"), is_query.alias("asked"))
    return top_k(v.filter("asked").select("id", "v"), v.select("id", "v"), k, **options)

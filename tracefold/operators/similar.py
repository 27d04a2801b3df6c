"""Similar incidents: G3 hash embedding, W9/J7 exact top-k cosine, S5 upsert.

Exact k-nearest-neighbours is a block matrix product.  Both tables are packed
into rows of a block of vectors each.  A task keeps its part of the queries and
reads the whole index past it, a block at a time (a cartesian product of blocks,
whose index side is read from where it was written once): no vector is copied
for the blocks it meets.  No (query, index) pair is ever a row: a task holds the
``k`` best of its queries, and a final ``row_number() <= k`` merges what rows of
the same query id have.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
HASH_ROUNDS = 24            # sha512 digests of text + "_" + i, i = 0..23
EMBED_DIM = 1536            # output length; the hash fills the first 768 values
HASH_VALUES = 768           # 24 * 64 bytes / 2 bytes per value
DEFAULT_TOP_K = 5
# ---------------------------------------------------------------------------


def hash_embedding(df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
    """Deterministic embedding of a text column, in native expressions.

    Bytes of sha512(text + '_' + i) for i = 0..23 are read in little-endian
    pairs ``(b0 + 256*b1) / 65535 * 2 - 1``; the rest of the 1536 values are 0;
    an empty text embeds to all zeros.  The digests are computed once per row
    (their own column) and the 768 values are read from that column."""
    t = F.col(text)
    hexes = F.concat(*[F.sha2(F.concat(t, F.lit(f"_{i}")), 512) for i in range(HASH_ROUNDS)])
    h = F.col("__digest")

    def byte(pos: Column) -> Column:  # pos = 0-based byte index
        return F.conv(F.substring(h, pos * 2 + 1, 2), 16, 10).cast("double")

    vals = F.transform(F.sequence(F.lit(0), F.lit(HASH_VALUES - 1)),
                       lambda k: (byte(k * 2) + F.lit(256.0) * byte(k * 2 + 1)) / F.lit(65535.0) * 2 - 1)
    emb = F.concat(vals, F.array_repeat(F.lit(0.0), EMBED_DIM - HASH_VALUES))
    return (df.withColumn("__digest", hexes)
            .withColumn(out, F.when(F.coalesce(t, F.lit("")) == "", F.array_repeat(F.lit(0.0), EMBED_DIM))
                        .otherwise(emb))
            .drop("__digest"))


def _blocks(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / max(1, block_rows)))


def top_k_similar(queries: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K, query_id: str = "query_id",
                  index_id: str = "index_id", vec: str = "embedding", exclude_self: bool = False,
                  min_similarity: float | None = 0.0, block_rows: int = 4096,
                  n_query_blocks: int | None = None, n_index_blocks: int = 1) -> DataFrame:
    """For every query row the ``k`` most cosine-similar index rows.

    Returns ``(query_id, index_id, similarity, rank)``; similarity is in
    [-1, 1] and rows below ``min_similarity`` are dropped (the reference's
    retrieved incidents must lie in [0, 1]).  Ties: smaller index id first.

    The queries are dealt to ``n_query_blocks`` tasks, and each of them reads the
    index in turn, ``n_index_blocks`` parts of it on their own."""
    if n_query_blocks is None:
        n_query_blocks = _blocks(queries.count(), block_rows)
    id_type = {c: d.schema[c].dataType for d, c in ((queries, query_id), (index, index_id))}
    q = _packed(queries, query_id, vec, block_rows, "q").repartition(n_query_blocks)
    x = _packed(index, index_id, vec, block_rows, "x").repartition(n_index_blocks)
    # the index is the streamed side and the queries' part the kept one; without the hint
    # small sides would be broadcast, and one task would read the queries
    pairs = x.hint("shuffle_replicate_nl").crossJoin(q)

    def block_top_k(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, _Best] = {}
        x_no, xids, xv = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if row["x_no"].as_py() != x_no:
                    x_no, xids, xv = row["x_no"].as_py(), row["x_ids"].values, _matrix(row, "x")
                q_no = row["q_no"].as_py()
                if q_no not in best:
                    best[q_no] = _Best(row["q_ids"].values, _matrix(row, "q"), k, min_similarity, exclude_self)
                best[q_no].meet(xids, xv)
        for b in best.values():
            yield pa.RecordBatch.from_arrays(b.rows(), names=["qid", "xid", "similarity"])

    cand = pairs.mapInArrow(block_top_k, T.StructType([
        T.StructField("qid", id_type[query_id]), T.StructField("xid", id_type[index_id]),
        T.StructField("similarity", T.DoubleType())]))
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), F.col("xid"))
    top = cand.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return top.select(F.col("qid").alias(query_id), F.col("xid").alias(index_id), "similarity", "rank")


def _packed(df: DataFrame, id_col: str, vec: str, block_rows: int, side: str) -> DataFrame:
    """``(no, ids, dim, data)``, named after ``side``: blocks of vectors with a norm, as
    they come, each a row.  ``data`` holds the values as float where the table has floats."""
    wide = not isinstance(df.schema[vec].dataType.elementType, T.FloatType)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>" if wide else "array<float>").alias("v"))
    kind, value = ("<f8" if wide else "<f4"), (pa.float64() if wide else pa.float32())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mats, held = [], [], 0

        def block() -> pa.RecordBatch:
            m, i = np.concatenate(mats), pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), i),
                 pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())],
                names=[f"{side}_no", f"{side}_ids", f"{side}_dim", f"{side}_data"])

        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("v")), 0), 0))
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().cast(value).to_numpy(zero_copy_only=False).astype(kind, copy=False)
            lengths = pc.unique(pc.list_value_length(batch.column("v"))).to_pylist()
            if len(lengths) > 1 or mats and mats[0].shape[1] != lengths[0]:
                raise ValueError(f"vectors of different lengths: {lengths}")
            m = flat.reshape(batch.num_rows, lengths[0])
            ok = _norms(m) > 0
            m, part = m[ok], batch.column("id").filter(pa.array(ok))
            for first in range(0, len(m), block_rows):
                some = m[first:first + block_rows]
                if held + len(some) > block_rows:
                    yield block()
                    ids, mats, held = [], [], 0
                ids.append(part.slice(first, len(some)))
                mats.append(some)
                held += len(some)
        if held:
            yield block()

    return rows.mapInArrow(pack, T.StructType([
        T.StructField(f"{side}_no", T.StringType()), T.StructField(f"{side}_ids", T.ArrayType(df.schema[id_col].dataType)),
        T.StructField(f"{side}_dim", T.IntegerType()), T.StructField(f"{side}_data", T.BinaryType())]))


def _matrix(row: dict, side: str) -> np.ndarray:
    data, n = row[f"{side}_data"].as_buffer(), len(row[f"{side}_ids"])
    dim = row[f"{side}_dim"].as_py()
    return np.frombuffer(data, "<f8" if len(data) == 8 * n * dim else "<f4").reshape(n, dim).astype(np.float64)


def _norms(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64, copy=False)
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def _plain(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numpy values, and which of them are there; a missing one has some value of the others."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), there
    values = ids.to_pylist()
    some = next((v for v in values if v is not None), None)
    out = np.empty(len(values), dtype=object)
    out[:] = [some if v is None else v for v in values]
    return out, there


class _Best:
    """The best ``k`` index rows so far of every query of a block.

    A product in single precision tells which pairs can be among them: its error is
    below ``slack``.  Only those pairs are worked out in double precision, each on its
    own, so that equal vectors have equal similarities wherever they stand."""

    TILE = 256          # queries of a product: it stays in the processor's cache
    PAIRS = 1 << 16     # pairs worked out at once

    def __init__(self, ids: pa.Array, m: np.ndarray, k: int, least: float | None, exclude_self: bool):
        self.arrow, (self.ids, self.there), self.m, self.k = ids, _plain(ids), m, k
        self.least, self.exclude_self = -np.inf if least is None else least, exclude_self
        self.norm = _norms(m)
        self.unit = (m / self.norm[:, None]).astype(np.float32)
        self.slack = (m.shape[1] + 8) * 2.0 ** -23
        self.kth = np.full(len(m), self.least)          # of a query with k rows, else the least similarity
        self.full = np.zeros(len(m), dtype=bool)
        self.row, self.sim = np.empty(0, np.int64), np.empty(0)
        self.xid, self.xthere, self.xtype = None, np.empty(0, bool), None

    def meet(self, xids: pa.Array, xm: np.ndarray) -> None:
        ids, there = _plain(xids)
        if self.xid is None:
            self.xid, self.xtype = ids[:0], xids.type
        norm = _norms(xm)
        unit = np.ascontiguousarray((xm / norm[:, None]).astype(np.float32).T)
        own_row, own_col = self._own(ids, there) if self.exclude_self else (np.empty(0, np.int64),) * 2
        found: list[tuple] = []
        out = np.empty((self.TILE, len(xm)), np.float32)
        for a in range(0, len(self.m), self.TILE):
            b = min(a + self.TILE, len(self.m))
            rough = np.matmul(self.unit[a:b], unit, out=out[:b - a])
            own = slice(*np.searchsorted(own_row, [a, b]))
            rough[own_row[own] - a, own_col[own]] = -np.inf
            floor = self.kth[a:b] - self.slack
            new = np.flatnonzero(~self.full[a:b])
            if len(new) and len(xm) > self.k:
                at = len(xm) - self.k
                part = np.where(np.isnan(rough[new]), -np.inf, rough[new])
                floor[new] = np.maximum(floor[new], np.partition(part, at, axis=1)[:, at] - 2 * self.slack)
            hot = np.flatnonzero(~(rough.max(axis=1) < floor))     # a row with a NaN too
            rows, cols = np.nonzero(rough[hot] >= floor[hot][:, None])
            rows = hot[rows]
            for c in range(0, len(rows), self.PAIRS):
                r, x = rows[c:c + self.PAIRS] + a, cols[c:c + self.PAIRS]
                sim = np.einsum("ij,ij->i", self.m[r], xm[x]) / (self.norm[r] * norm[x])
                keep = np.isfinite(rough[r - a, x]) & np.isfinite(sim) & (sim >= self.kth[r])
                if keep.any():
                    found.append((r[keep], sim[keep], ids[x[keep]], there[x[keep]]))
        if found:
            self._merge(found)

    def _own(self, ids: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, index row) of the same id, by query."""
        order = np.flatnonzero(there)
        order = order[np.argsort(ids[order], kind="stable")]
        first = np.searchsorted(ids[order], self.ids, "left")
        n = np.where(self.there, np.searchsorted(ids[order], self.ids, "right") - first, 0)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(n)), n), order[np.repeat(first, n) + nth]

    def _merge(self, found: list[tuple]) -> None:
        row = np.concatenate([self.row, *[f[0] for f in found]])
        sim = np.concatenate([self.sim, *[f[1] for f in found]])
        xid = np.concatenate([self.xid, *[f[2] for f in found]])
        there = np.concatenate([self.xthere, *[f[3] for f in found]])
        number = np.unique(xid, return_inverse=True)[1]  # the ids' order
        order = np.lexsort((number, there, -sim, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = order[nth < self.k]
        self.row, self.sim, self.xid, self.xthere = row[nth < self.k], sim[kept], xid[kept], there[kept]
        last = (nth == self.k - 1)
        self.kth[row[last]] = sim[order[last]]
        self.full[row[last]] = True

    def rows(self) -> list[pa.Array]:
        xid = pa.array(self.xid, type=self.xtype, mask=~self.xthere)
        return [self.arrow.take(pa.array(self.row)), xid, pa.array(self.sim)]


def upsert_incidents(*versions: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Last write per id wins (highest ``version``), as one aggregation
    (partial per mapper) over the union of all writes."""
    u = versions[0]
    for v in versions[1:]:
        u = u.unionByName(v, allowMissingColumns=True)
    cols = [c for c in u.columns if c != key]
    latest = u.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("r"))
    return latest.select(key, "r.*")


def learned_incident_id(title: Column) -> Column:
    """Id under which a successful remediation is stored: ``learned_`` + the
    lower-cased title with spaces replaced by underscores."""
    return F.concat(F.lit("learned_"), F.lower(F.replace(title, F.lit(" "), F.lit("_"))))

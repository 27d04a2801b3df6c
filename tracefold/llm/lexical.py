"""Ranked lexical search: no-random-access (NRA) reading of impact-sorted lists.

The k best documents for each item of a query table, over all documents.

1. One scan of the documents keeps, per document, its number of terms and the
   counts of those terms that may occur in an item.  A Bloom filter of fixed
   size (``BLOOM_BITS``) over the items' terms does that sieving, so what is
   sent to the tasks does not grow with the items; false hits fall out later.
2. Document frequencies and totals are plain aggregations over the kept terms.
3. Items go in groups of at most about ``GROUP_TERMS`` terms, by hash.
   For a group every task reads its documents in blocks of at most
   ``BLOCK_POSTINGS`` postings and ``BLOCK_DOCS`` documents, sorts each term's list by impact and reads the
   lists of an item from the top.  Every document met has a lower score (what
   was read) and an upper score (plus the next impact of each list in which it
   was not met).  Reading goes on until no document outside can enter, nor tie,
   and the documents inside have equal lower and upper scores: membership, ties
   and scores are then exact.  The k-th score of the blocks before is a floor
   for the next ones.  Block results merge by ``row_number() <= k``.

Posting lists are never shuffled, and no task holds more than a block (or one
document, where that is larger).

Defined results: a null or empty text has no terms and is never found; an item
without terms, or one whose terms occur nowhere, has no rows.  Equal scores go
by ascending id, null ids last; repeated rows are documents of their own.  An
item id may repeat, then its rows are items of their own and share the id; a
null item id is an id.  Empty tables give no rows.  Very long texts are read
whole.  Only id and text of either table are read, so no extra column can clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracefold.llm.bytewords import Memo, raw, slices, words
from tracefold.llm.common import written

TOP = 10
#: Fixed values of the score: impact = w * (SCALE * tf) div (1000 * tf + 8 * m),
#: m = (100 - LENGTH) + (LENGTH * n * N) div L.
SCALE = 1_000_000_000
LENGTH = 75
#: bits of the filter over the items' terms (1 MiB)
BLOOM_BITS = 1 << 23
#: terms of the items that are searched in one pass over the documents
GROUP_TERMS = 400_000
#: postings that a task sorts at once
BLOCK_POSTINGS = 1 << 21
BLOCK_DOCS = 1 << 17
#: postings of each list that the first round reads; later rounds read four times as deep
FIRST_READ = 256


def term_counts(queries: DataFrame, item: str, text: str) -> DataFrame:
    """(q, item, term, qtf): the distinct terms of every item; q numbers its rows."""
    src = queries.select(F.col(item).alias("item"), F.col(text).cast("string").alias("t")).withColumn(
        "q", F.monotonically_increasing_id())
    kind = src.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, term, n = [], [], []
            for i, t in enumerate(raw(b.column("t"))):
                counts = Counter(words(t))
                row.extend([i] * len(counts))
                term.extend(counts)
                n.extend(counts.values())
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("q").take(row), b.column("item").take(row), pa.array(term, pa.binary()),
                                              pa.array(n, pa.int64())], ["q", "item", "term", "qtf"])

    return src.mapInArrow(run, f"q long, item {kind}, term binary, qtf long")


def bloom(terms: DataFrame) -> bytes:
    """A filter of ``BLOOM_BITS`` bits with three bits a term, merged from one per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, dtype=bool)
        for b in batches:
            for w in b.column("term").to_pylist():
                bits[list(places(w))] = True
        packed = np.packbits(bits)
        hit = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(packed[hit].astype(np.int32))], ["at", "bits"])

    merged = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    rows = terms.select("term").mapInArrow(run, "at int, bits int").groupBy("at").agg(
        F.bit_or("bits").alias("bits")).toArrow()  # at most BLOOM_BITS / 8 rows
    merged[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return merged.tobytes()


def places(word: bytes) -> tuple[int, int, int]:
    a, b = crc32(word), crc32(word, 0x5BD1E995) | 1
    return a % BLOOM_BITS, (a + b) % BLOOM_BITS, (a + 2 * b) % BLOOM_BITS


def forward_index(df: DataFrame, sieve: bytes, text: str, key: str) -> DataFrame:
    """(k, n, terms, tfs) of the documents that have terms: their number, and the
    counts of those that pass the filter."""
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda w: all(sieve[p >> 3] >> (7 - (p & 7)) & 1 for p in places(w)))
        for b in slices(batches):
            row, size, ends, terms, tfs = [], [], [0], [], []
            for i, t in enumerate(raw(b.column("t"))):
                ws = words(t)
                if not ws:
                    continue
                for w, n in Counter(ws).items():
                    if known[w]:
                        terms.append(w)
                        tfs.append(n)
                row.append(i)
                size.append(len(ws))
                ends.append(len(terms))
            off = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(pa.array(row, pa.int32())), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(off, pa.array(terms, pa.binary())),
                 pa.ListArray.from_arrays(off, pa.array(tfs, pa.int64()))], ["k", "n", "terms", "tfs"])

    return src.mapInArrow(run, f"k {kind}, n long, terms array<binary>, tfs array<long>")


class Block:
    """Impact-sorted lists of the terms of one block of documents."""

    def __init__(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(doc))
        self.ids = ids
        # places of the documents by ascending id, null ids last
        self.place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        self.lower = np.zeros(len(ids), dtype=np.int64)
        self.rest = np.zeros(len(ids), dtype=np.int64)

    def search(self, terms: np.ndarray, qtf: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(document, score) of the k best documents that reach ``floor``, and all that tie."""
        at = np.searchsorted(self.terms, terms)
        have = at < len(self.terms)
        have[have] = self.terms[at[have]] == terms[have]
        lists = [(self.doc[self.starts[t]:self.ends[t]], self.impact[self.starts[t]:self.ends[t]] * f)
                 for t, f in zip(at[have], qtf[have])]
        if sum(int(i[0]) for _, i in lists) < max(floor, 1):
            return []
        lower, rest = self.lower, self.rest
        lower[:] = 0
        read, depth = 0, FIRST_READ
        while True:
            for d, i in lists:
                lower[d[read:depth]] += i[read:depth]
            read = depth
            nexts = [int(i[read]) if len(i) > read else 0 for _, i in lists]
            unseen = sum(nexts)
            best = min(k, len(lower))
            bar = max(floor, int(np.partition(lower, len(lower) - best)[len(lower) - best]) if best == k else 0, 1)
            if unseen < bar:  # no document that was not met can enter or tie
                rest[:] = unseen
                for (d, _), x in zip(lists, nexts):
                    if x:
                        rest[d[:read]] -= x
                able = np.flatnonzero(lower + rest >= bar)
                able = able[lower[able] > 0]
                if not rest[able].any():  # scores are settled
                    return [(int(j), int(lower[j])) for j in able]
            depth = read * 4


def search_group(index: DataFrame, numbers: dict[bytes, int], weight: np.ndarray,
                 items: list[tuple[int, np.ndarray, np.ndarray]], docs: int, total: int, k: int) -> DataFrame:
    """(q, k, score): the k best documents of every item, for each task."""
    kind = index.schema["k"].dataType.simpleString()
    id_type = to_arrow_type(index.schema["k"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {q: [] for q, _, _ in items}

        def finish(held):
            ids = pa.concat_arrays([h[0] for h in held])
            m = (100 - LENGTH) + (LENGTH * np.concatenate([h[1] for h in held]) * docs) // total
            doc = np.concatenate([h[2] for h in held])
            term, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            block = Block(ids, doc, term, weight[term] * ((SCALE * tf) // (1000 * tf + 8 * m[doc])))
            for q, terms, qtf in items:
                mine = best[q]
                found = block.search(terms, qtf, k, mine[-1][0] if len(mine) == k else 1)
                found = heapq.nsmallest(k, found, key=lambda x: (-x[1], block.place[x[0]]))
                names = ids.take(pa.array([d for d, _ in found], pa.int64())).to_pylist()
                mine.extend((s, i) for (_, s), i in zip(found, names))
                mine.sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
                del mine[k:]

        held, n_docs, n_postings = [], 0, 0
        for b in batches:
            for piece in slices(iter([b])):
                terms = piece.column("terms")
                flat = terms.flatten().dictionary_encode()
                local = np.array([numbers.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1], dtype=np.int64)
                term = local[flat.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.int64)
                doc = np.repeat(np.arange(piece.num_rows), np.diff(terms.offsets.to_numpy()))
                tf = piece.column("tfs").flatten().to_numpy()
                mine = term >= 0
                held.append((piece.column("k"), piece.column("n").to_numpy(), doc[mine] + n_docs, term[mine], tf[mine]))
                n_docs += piece.num_rows
                n_postings += int(mine.sum())
                if n_postings >= BLOCK_POSTINGS or n_docs >= BLOCK_DOCS:
                    if n_postings:
                        finish(held)
                    held, n_docs, n_postings = [], 0, 0
        if n_postings:
            finish(held)
        rows = [(q, i, s) for q, mine in best.items() for s, i in mine]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type),
             pa.array([r[2] for r in rows], pa.int64())], ["q", "k", "score"])

    return index.select("k", "n", "terms", "tfs").mapInArrow(run, f"q long, k {kind}, score long")


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id",
         item: str = "item_id", query_text: str = "text") -> DataFrame:
    """(``item``, rank, ``key``, score): the k best documents of every item with a score above 0."""
    terms = written(term_counts(queries, item, query_text), "search-terms")
    index = written(forward_index(docs, bloom(terms), text, key), "search-index")
    size = index.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    found = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = written(terms.join(found, "term"), "search-known")
    groups = max(1, math.ceil(known.count() / GROUP_TERMS))
    results = []
    for g in range(groups):
        rows = known.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).select("q", "term", "qtf", "df").toArrow()
        names = rows["term"].combine_chunks().dictionary_encode() if len(rows) else None
        numbers = {w: n for n, w in enumerate(names.dictionary.to_pylist())} if len(rows) else {}
        number = names.indices.to_numpy() if len(rows) else np.zeros(0, dtype=np.int32)
        weight = np.zeros(len(numbers) + 1, dtype=np.int64)
        weight[number] = [term_weight(size["docs"], n) for n in rows["df"].to_pylist()]
        q, qtf = rows["q"].to_numpy(), rows["qtf"].to_numpy()
        order = np.argsort(q, kind="stable")
        cuts = np.flatnonzero(np.diff(q[order])) + 1
        items = [(int(q[i[0]]), number[i].astype(np.int64), qtf[i]) for i in np.split(order, cuts) if len(i)]
        results.append(written(search_group(index, numbers, weight, items, size["docs"], max(size["total"], 1), k),
                               "search-found"))
    hits = results[0]
    for r in results[1:]:
        hits = hits.unionByName(r)
    best = hits.withColumn("rank", F.row_number().over(
        Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("k").asc_nulls_last()))).where(F.col("rank") <= k)
    return best.join(known.select("q", "item").distinct(), "q").select(
        F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("k").alias(key), "score")

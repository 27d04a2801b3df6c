"""Best-fit packing of token pieces by the linear grouping scheme.

1. Every document becomes ids plus the end id 0; only documents over the
   capacity are cut, into full pieces (the first one takes the remainder).
2. The number of pieces per length (at most ``capacity`` counters, whatever the
   corpus size) goes to the driver, which plans on counts alone: large lengths
   are put, by rank, into groups of equal cardinality and rounded up to their
   group's largest; the few rounded sizes are packed by an optimised set of
   configurations (column generation for the covering LP, rounded down);
   the slots of a configuration then take actual lengths, and what is left,
   the small lengths first of all, goes to the fullest sequence it fits
   (best fit, longest first), else to a new one.
3. The plan is a table of runs - (length, ordinals from..to) -> sequence, offset.
   Each piece gets its ordinal within its length (a count per written part and
   length, summed up over the parts, plus its rank in the part: no task sees a
   whole length) and looks its place up.

Defined results: a null text is empty and still carries its end id; repeated
rows and ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import written

CAPACITY = 2048
END_ID = 0
#: Lengths up to this are small; the border that needs the fewest sequences is taken.
SMALL = (CAPACITY // 8, CAPACITY // 4, CAPACITY // 3, CAPACITY // 2)
#: Equal-cardinality groups of the large lengths.
GROUPS = 64
#: Words of a generation whose ids a worker remembers, at most (about 320 bytes each, two generations).
CACHE_WORDS = 500_000
_STOPS = (".", ",")
#: White space other than a single blank or line end between words, as a pattern's alternatives.
_GAPS = (r"[ \n][ \n]", r"\A[ \n]", r"[ \n]\z",
         "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Column generation rounds at most (each adds one configuration).
COLUMNS = 600



class ChunkCoder:
    """Token ids of texts, word by word.

    The byte-level pre-tokenizer starts a new word at white space that follows
    something else.  So where words stand apart by single blanks and line ends,
    the ids of a text are those of its words in order, each with the blank (not
    written in the key) or line end before it.  Any other text, and one with a
    special token, is encoded whole.

    A batch is split and its distinct words are numbered by Arrow; only these are
    looked up.  New ones are encoded together, a line each: the line end is a token
    of its own there, which no word holds, so it tells them apart.  The memory of
    words has two generations of at most ``words`` each: a full one becomes the
    old one, and words found there move up, so frequent words are never lost."""

    def __init__(self, path: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.bound = words
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.line_end = self._whole("\n")
        assert len(self.line_end) == 1
        self.stops = {x: self._whole(x).tobytes() for x in _STOPS}
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.not_simple = "|".join([*special, *_GAPS])

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _lines(self, lines: list[str]) -> list[bytes]:
        """Ids of short texts without a line end."""
        out: list[bytes] = []
        for at in range(0, len(lines), 4096):
            part = lines[at:at + 4096]
            ids = self._whole("\n".join(part))
            cuts = np.flatnonzero(ids == self.line_end[0])
            raw = ids.tobytes()
            starts = [0, *((cuts + 1) * 4).tolist()]
            ends = [*(cuts * 4).tolist(), len(raw)]
            assert len(starts) == len(part)
            out.extend(raw[a:b] for a, b in zip(starts, ends))
        return out

    def _learn(self, fresh: list[str]) -> None:
        # a stop or comma after a letter or digit is a token run of its own
        stopped = [w for w in fresh if w[-1] in self.stops and w[-2:-1].isalnum()]
        plain = set(fresh).difference(stopped)
        plain.update(w for w in {w[:-1] for w in stopped} if w not in self.words)
        todo = list(plain)
        # keys: blank before (not written), first word of a text (carriage return), first of a line (line end)
        marked = [w[0] == "\n" for w in todo]
        ids = self._lines([w[1:] if w[0] in "\r\n" else " " + w for w in todo])
        before = self.line_end.tobytes()
        self.words.update(zip(todo, (before + i if m else i for i, m in zip(ids, marked))))
        self.words.update((w, self.words[w[:-1]] + self.stops[w[-1]]) for w in stopped)

    def _values(self, distinct: list[str]) -> list[bytes]:
        if len(self.words) > self.bound:
            self.old, self.words = self.words, {}
        values = list(map(self.words.get, distinct))
        missing = [i for i, v in enumerate(values) if v is None]
        fresh = []
        for i in missing:
            v = self.old.get(distinct[i])
            if v is None:
                fresh.append(distinct[i])
            else:
                self.words[distinct[i]] = v
        self._learn(fresh)
        for i in missing:
            values[i] = self.words[distinct[i]]
        for w in fresh:
            if len(w) > 64:
                del self.words[w]
        return values

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text."""
        whole = pc.or_(pc.match_substring_regex(texts, self.not_simple), pc.equal(pc.binary_length(texts), 0))
        simple = texts.filter(pc.invert(whole))
        out: list = [None] * len(texts)
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._whole(texts[i].as_py())
        if len(simple):
            marked = pc.binary_join_element_wise("\r", pc.replace_substring(simple, "\n", " \n"), "")
            keys = pc.split_pattern(marked, " ")
            numbers = keys.flatten().dictionary_encode()
            values = self._values(numbers.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(values), dtype="<u4")
            size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
            start = np.cumsum(size) - size
            at = numbers.indices.to_numpy()
            n = size[at]
            end = np.cumsum(n)
            ids = flat[np.repeat(start[at] - end + n, n) + np.arange(end[-1])]
            border = np.concatenate([[0], end])[keys.offsets.to_numpy()]
            for k, i in enumerate(np.flatnonzero(~whole.to_numpy(zero_copy_only=False)).tolist()):
                out[i] = ids[border[k]:border[k + 1]]
        return out


_CODERS: dict[tuple[str, int], ChunkCoder] = {}


def coder_for(path: str, words: int = CACHE_WORDS) -> ChunkCoder:
    """One coder per Python worker, so that its words serve the worker's next task."""
    if (path, words) not in _CODERS:
        _CODERS[path, words] = ChunkCoder(path, words)
    return _CODERS[path, words]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
           with_ids: bool = False, words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32 and, on
    request, ``ids`` (little-endian 32-bit ids).  ``words`` bounds what a worker
    remembers between batches: less memory for more time, the same ids."""
    key_type = df.schema[key].dataType
    src = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    schema = f"k {key_type.simpleString()}, {PIECE_SCHEMA}" + (", ids binary" if with_ids else "")
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(tokenizer, words)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows, cols = [], defaultdict(list)
                for i, ids in enumerate(coder.encode(b.column("t"))):
                    for p, (start, n) in enumerate(cut(len(ids) + 1, capacity)):
                        part = ids[start:start + n]
                        last = end if len(part) < n else b""
                        rows.append(i)
                        for c, v in (("piece", p), ("start", start), ("length", n), ("crc", zlib.crc32(last, zlib.crc32(part)))):
                            cols[c].append(v)
                        if with_ids:
                            cols["ids"].append(part.tobytes() + last)
                data = [b.column("k").take(pa.array(rows, pa.int32())), pa.array(cols["piece"], pa.int32()),
                        pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int64()),
                        pa.array(cols["crc"], pa.int64())]
                names = ["k", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    data.append(pa.array(cols["ids"], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(data, names)
        pa.default_memory_pool().release_unused()  # the worker stays, for other stages too

    return src.mapInArrow(run, schema).withColumnRenamed("k", key)


# --------------------------------------------------------------------- planning on counts

def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, dict[int, int]]]:
    """Longest first, ranks cut into ``groups`` groups of equal cardinality;
    (largest length, {length: count}) of each; groups of one size are joined."""
    total = sum(counts.values())
    share = max(1, -(-total // groups))
    out: list[tuple[int, dict[int, int]]] = []
    room = 0
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            if not room:
                if not out or out[-1][0] != n:
                    out.append((n, {}))
                room = share
            take = min(room, left)
            out[-1][1][n] = out[-1][1].get(n, 0) + take
            left, room = left - take, room - take
    return out


def _best_pattern(sizes: list[int], value: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of largest value (unbounded knapsack by size)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, dtype=np.int64)
    for g, s in enumerate(sizes):
        if value[g] <= 1e-12:
            continue
        for _ in range(capacity // s):
            better = best[:-s] + value[g]
            up = better > best[s:] + 1e-12
            if not up.any():
                break
            best[s:][up] = better[up]
            last[s:][up] = g
    # walk back along the last added size; the value of a prefix is rebuilt exactly
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        g = last[c]
        if g < 0:
            break
        pattern[g] += 1
        c -= sizes[g]
    return pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, columns: int) -> list[tuple[np.ndarray, float]]:
    """Covering LP over configurations by column generation (primal simplex on
    the basis of one-size configurations); (configuration, amount) pairs."""
    g = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    b = np.asarray(demand, dtype=float)
    inv = np.linalg.inv(basis)
    for n in range(columns):
        dual = inv.sum(axis=0)
        new = _best_pattern(sizes, dual, capacity)
        if dual @ new <= 1 + 1e-7:
            break
        d, x = inv @ new, inv @ b
        ok = d > 1e-9
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = new
        if n % 50 == 49:
            inv = np.linalg.inv(basis)
        else:
            row = inv[out] / d[out]
            inv = inv - np.outer(d, row)
            inv[out] = row
    x = np.linalg.solve(basis, b)
    return [(basis[:, j].round().astype(np.int64), float(x[j])) for j in range(g) if x[j] > 1e-9]


class Plan:
    """Runs of like sequences: each holds (lengths so far, how many sequences)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        self.free: list[int] = []  # residuals that have runs, sorted

    def add(self, lengths: tuple[int, ...], n: int) -> None:
        if n <= 0:
            return
        rest = self.capacity - sum(lengths)
        if rest not in self.open or not self.open[rest]:
            bisect.insort(self.free, rest)
        self.open[rest].append((lengths, n))

    def best_fit(self, length: int, n: int) -> None:
        """Put ``n`` pieces of one length into the fullest sequences they fit."""
        while n:
            at = bisect.bisect_left(self.free, length)
            if at == len(self.free):
                each = min(self.capacity // length, n)
                self.add((length,) * each, n // each)
                self.add((length,) * (n % each), 1 if n % each else 0)
                return
            rest = self.free[at]
            lengths, m = self.open[rest].pop()
            if not self.open[rest]:
                self.free.pop(at)
            each = min(rest // length, max(1, n // m))
            used = min(m, n // each)
            self.add(lengths + (length,) * each, used)
            self.add(lengths, m - used)
            n -= used * each

    def runs(self) -> list[tuple[tuple[int, ...], int]]:
        return [r for rest in sorted(self.open) for r in self.open[rest]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, smalls: tuple[int, ...] = SMALL, groups: int = GROUPS,
         columns: int = COLUMNS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in a sequence, number of such sequences) that hold every
    piece: the shortest plan over the given borders between small and large."""
    return min((_plan(counts, capacity, s, groups, columns) for s in smalls), key=lambda r: sum(n for _, n in r))


def _plan(counts: dict[int, int], capacity: int, small: int, groups: int,
          columns: int) -> list[tuple[tuple[int, ...], int]]:
    out = Plan(capacity)
    left = dict(counts)
    full = left.pop(capacity, 0)
    large = {n: c for n, c in left.items() if n > small}
    if large:
        made = grouped(large, groups)
        sizes, members = [s for s, _ in made], [dict(sorted(m.items(), reverse=True)) for _, m in made]
        for config, amount in configurations(sizes, [sum(m.values()) for m in members], capacity, columns):
            todo = int(amount + 1e-6)
            slots = [g for g in range(len(sizes)) for _ in range(config[g])]
            while todo:
                # one actual length per slot, as long as they last
                need: dict[tuple[int, int], int] = defaultdict(int)
                chosen = []
                for g in slots:
                    n = next((n for n, c in members[g].items() if c > need[g, n]), None)
                    if n is None:
                        break
                    need[g, n] += 1
                    chosen.append((g, n))
                if len(chosen) < len(slots):
                    break
                per = {k: c for k, c in need.items() if c}
                times = min([todo] + [members[g][n] // k for (g, n), k in per.items()])
                if not times:
                    break
                for (g, n), k in per.items():
                    members[g][n] -= times * k
                    if not members[g][n]:
                        del members[g][n]
                out.add(tuple(n for _, n in chosen), times)
                todo -= times
        rest: dict[int, int] = defaultdict(int)
        for m in members:
            for n, c in m.items():
                rest[n] += c
    else:
        rest = {}
    for n, c in left.items():
        if n <= small:
            rest[n] = rest.get(n, 0) + c
    for n in sorted(rest, reverse=True):
        out.best_fit(n, rest[n])
    out.add((capacity,), full)
    return out.runs()


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as a lookup table sorted by (length, first ordinal)."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, n in runs:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], base, offset))
            used[x] += n
            offset += x
        base += n
    rows.sort()
    names = ("length", "first", "base", "offset")
    cols = np.asarray(rows, dtype=np.int64).reshape(-1, 4).T
    return {k: cols[i] for i, k in enumerate(names)}


# --------------------------------------------------------------------- on the corpus

def pack(cut_pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY,
         smalls: tuple[int, ...] = SMALL, groups: int = GROUPS) -> DataFrame:
    """``cut_pieces`` (from ``pieces``) with ``sequence_id`` and ``offset``."""
    stored = written(cut_pieces.withColumn("part", F.spark_partition_id()), "pieces")
    by_part = stored.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most `capacity` rows, whatever the corpus size
    counts = {r[0]: r[1] for r in stored.groupBy("length").count().collect()}
    table = places(plan(counts, capacity, smalls, groups))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy(F.col(key), F.col("piece")))
    placed = (stored.withColumn("rank", rank).join(by_part, ["length", "part"])
              .withColumn("ordinal", F.col("before") + F.col("rank") - 1).drop("rank", "before", "part"))
    names = placed.columns
    starts = (table["length"] << 44) + table["first"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            ordinal = b.column("ordinal").to_numpy()
            at = np.searchsorted(starts, (length << 44) + ordinal, side="right") - 1
            seq = table["base"][at] + ordinal - table["first"][at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names if n != "ordinal"), pa.array(seq), pa.array(table["offset"][at])],
                [*(n for n in names if n != "ordinal"), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "ordinal")
    return placed.mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed with their ids; a
    sequence has at most ``capacity`` ids, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")
    return packed_with_ids.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("hex")).select(
        "sequence_id", "n_tokens", F.unhex("hex").alias("ids"))

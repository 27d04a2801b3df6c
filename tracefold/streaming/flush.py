"""T1 stream_flush + T2 prune_window: the log agent's keyed flush buffer as a
Structured Streaming stateful operator (``applyInPandasWithState``).

Per source the state holds the buffered entries of the last ``window_seconds``,
the time of the last flush, the newest time and a flush counter.  Lines are folded
into entries per file inside the batch (the file source delivers whole files, so a
file is one ordered unit) before any of them is judged by its time, so a line
always stays with its own entry.  Entries are sorted by (ts, file, line) and
replayed; every one of them leaves with exactly one reason, or stays buffered:

* ERROR entry -> emit buffer + entry, reason ``error_detected``, clear;
* ``flush_interval_seconds`` set and that much event time since the last
  flush -> emit the buffer, reason ``time_elapsed``, clear;
* a control line ``FLUSH`` or ``SHUTDOWN`` -> emit, reason ``manual`` / ``shutdown``;
* entries older than ``window_seconds`` before the newest leave as ``pruned`` (T2);
* entries behind the *source's own* newest ts by more than the allowed lateness
  leave as ``late``;
* with ``max_entries`` set, the oldest beyond it leave as ``overflow``;
* lines before the first head of their file leave as ``orphan``.

Lateness is judged per source, never by a watermark: Spark's watermark is global,
and a source that lags behind the others would lose its rows to it.  With ``idle``
set, a source without data for so long (processing time) gives its buffer out as
``shutdown`` and keeps its counters only; that suits a continuous trigger, as
Spark runs batches without data for it (``availableNow`` would not end).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefold.functions import text as T
from tracefold.functions import time as TM
from tracefold.functions.time import interval_seconds as _seconds

OUTPUT_SCHEMA = ("source_id string, flush_no long, reason string, flushed_at timestamp, file string, "
                 "entry_no long, ts timestamp, level string, message string")
STATE_SCHEMA = ("flush_no long, last_flush_us long, max_us long, buf_file array<string>, buf_entry array<long>, "
                "buf_us array<long>, buf_level array<string>, buf_msg array<string>")
#: rows of a frame that the state function gives out
OUTPUT_ROWS = 20_000
MANUAL_FLUSH = "FLUSH"
SHUTDOWN = "SHUTDOWN"
CONTROL = {MANUAL_FLUSH: "manual", SHUTDOWN: "shutdown"}


def prepare_lines(lines: DataFrame) -> DataFrame:
    """Per-line columns the state function needs (computed natively):
    ``is_head``, head ``ts`` (NULL on continuation lines) and head ``level``."""
    line = F.col("line")
    head = TM.is_head_b(line)
    return (lines.where(line.rlike(r"\S"))
            .withColumn("is_head", head | F.trim(line).isin(*CONTROL))
            .withColumn("ts", F.when(head, TM.ts_b(line)))
            .withColumn("level", F.when(head, T.level_b(line)).when(F.trim(line).isin(*CONTROL), F.trim(line))))


def _fold(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Lines of one source in this batch -> entries (per file, line order), and
    the lines before the first head of their file."""
    pdf = pdf[pdf["file"].notna()]
    pdf = pdf.sort_values(["file", "line_no"] if pdf["file"].nunique() > 1 else "line_no", kind="stable")
    head = pdf["is_head"].to_numpy(dtype=bool)
    files = pdf["file"].to_numpy()
    new = np.ones(len(pdf), dtype=bool)
    new[1:] = files[1:] != files[:-1]
    begin = np.flatnonzero(head | new)      # of entries, and of the lines before a file's first head
    end = np.append(begin[1:], len(pdf))
    orphan = np.repeat(~head[begin], end - begin)
    orphans, (begin, end) = pdf[orphan], (begin[head[begin]], end[head[begin]])
    if not len(begin):
        return pd.DataFrame(columns=["file", "entry_no", "us", "level", "message", "sort_us"]), orphans
    lines = pdf["line"].tolist()
    heads = pdf.iloc[begin]
    ts = pd.to_datetime(heads["ts"].reset_index(drop=True))
    out = pd.DataFrame({
        "file": files[begin],
        "entry_no": heads["line_no"].astype("int64").to_numpy(),
        "level": heads["level"].to_numpy(),
        "message": [lines[x] if y - x == 1 else "\n".join(lines[x:y]) for x, y in zip(begin.tolist(), end.tolist())],
    })
    out["us"] = ts.astype("datetime64[us]").astype("int64").where(ts.notna(), other=np.nan)
    # rows without a timestamp (control rows) keep their arrival position:
    # they sort at the time of the entry before them in the same file
    out["sort_us"] = out.groupby("file", sort=False)["us"].ffill()
    return out, orphans


LATE, PRUNED, FLUSHED = 0, 1, 2


def _replay(entries: pd.DataFrame, buf: list[tuple], flush_no: int, last_flush: int | None, max_us: int | None,
            win_us: int, late_us: int):
    """The buffer and the batch's sorted entries through the rules without a flush interval and a cap,
    for all of them at once.  An entry leaves at the first later one that prunes it (newer by more than
    the window) or flushes, a prune before a flush.  Times of entries do not fall within a batch, so both are
    looked up.  Returns ``(left, kept, flush_no, last_flush, max_us)``: a frame of what left, in the
    order in which it left, and the entries that stay buffered."""
    nb = len(buf)
    none = -(1 << 62)
    us = np.concatenate([np.array([none if b[2] is None else b[2] for b in buf], dtype=np.int64),
                         entries["us"].fillna(none).to_numpy().astype(np.int64)])
    timed = us != none
    file = np.concatenate([np.array([b[0] for b in buf], dtype=object), entries["file"].to_numpy(dtype=object)])
    number = np.concatenate([np.array([b[1] for b in buf], dtype=np.int64), entries["entry_no"].to_numpy(np.int64)])
    level = np.concatenate([np.array([b[3] for b in buf], dtype=object), entries["level"].to_numpy(dtype=object)])
    text = np.concatenate([np.array([b[4] for b in buf], dtype=object), entries["message"].to_numpy(dtype=object)])
    n, batch = len(us), np.arange(len(us)) >= nb
    newest = np.maximum.accumulate(np.where(batch, us, none))       # of the source, at each arrival
    if max_us is not None:
        newest = np.maximum(newest, max_us)
    before = np.concatenate([[none if max_us is None else max_us], newest[:-1]])
    late = batch & timed & (before != none) & (us < before - late_us)
    control = batch & np.isin(level, list(CONTROL))
    held = ~late & ~control                                         # in the buffer for a time
    ends = np.flatnonzero(batch & ~late & (control | (level == "ERROR")))
    clock = np.flatnonzero(batch & timed & ~late)
    pruned_by = np.append(clock, n)[np.searchsorted(us[clock], us + win_us, "right")]
    pruned_by = np.where(timed, np.maximum(pruned_by, 0), n)
    ended_by = np.append(ends, n)[np.searchsorted(ends, np.arange(n), "left")]
    flushed = held & (ended_by < n) & (pruned_by > ended_by)
    # a control line with nothing in the buffer is no flush
    counts = np.zeros(n + 1, dtype=np.int64)
    np.add.at(counts, ended_by[flushed], 1)
    flushes = ends[counts[ends] > 0]
    numbers = np.full(n + 1, -1, dtype=np.int64)
    numbers[flushes] = flush_no + np.arange(len(flushes))
    at = np.where(timed, us, newest)                                # an end without a time: the newest

    pruned = held & (pruned_by < n) & (pruned_by <= ended_by)
    kind = np.full(n, -1)
    kind[late], kind[pruned], kind[flushed] = LATE, PRUNED, FLUSHED
    when = np.where(late, np.arange(n), np.where(pruned, pruned_by, ended_by))
    go = np.flatnonzero(kind >= 0)
    go = go[np.lexsort((go, kind[go], when[go]))]
    w = np.minimum(when[go], n - 1)
    reason = np.array(["late", "pruned", "error_detected"], dtype=object)[kind[go]]
    by_line = np.flatnonzero((kind[go] == FLUSHED) & control[w])
    reason[by_line] = [CONTROL[x] for x in level[w[by_line]]]
    left = pd.DataFrame({"flush_no": np.where(kind[go] == FLUSHED, numbers[w], -1), "reason": reason,
                         "flushed_at": _times(at[w], none), "file": file[go], "entry_no": number[go],
                         "ts": _times(us[go], none), "level": level[go], "message": text[go]})
    stay = np.flatnonzero(held & (kind < 0))
    kept = [(file[i], int(number[i]), int(us[i]) if timed[i] else None, level[i], text[i]) for i in stay]
    if len(flushes):
        last_flush = None if at[flushes[-1]] == none else int(at[flushes[-1]])
        clock = clock[clock > flushes[-1]]
    if last_flush is None and len(clock):
        last_flush = int(us[clock[0]])
    if n and newest[-1] != none:
        max_us = int(newest[-1])
    return left, kept, flush_no + len(flushes), last_flush, max_us


def _times(us: np.ndarray, none: int) -> pd.Series:
    return pd.Series(us.astype("datetime64[us]")).where(us != none)


def make_flush_fn(window_seconds: int = 60, flush_interval_seconds: int | None = None,
                  max_entries: int | None = None, allowed_lateness_seconds: int = 60, idle_ms: int | None = None):
    win_us = window_seconds * 1_000_000
    interval_us = None if flush_interval_seconds is None else flush_interval_seconds * 1_000_000
    late_us = allowed_lateness_seconds * 1_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source = key[0]
        if state.exists:
            (flush_no, last_flush, max_us, bf, be, bu, bl, bm) = state.get
            buf = deque(zip(bf, be, bu, bl, bm))
        else:
            flush_no, last_flush, max_us, buf = 0, None, None, deque()
        out: list[tuple] = []
        left: pd.DataFrame | None = None
        disordered = any(x is None or y is None or x > y for x, y in zip([b[2] for b in buf], [b[2] for b in buf][1:]))

        def leave(entry, reason, at_us, number=-1):
            out.append((source, number, reason, at_us, *entry))

        def emit(reason, at_us):
            nonlocal flush_no, last_flush
            while buf:
                leave(buf.popleft(), reason, at_us, flush_no)
            flush_no += 1
            last_flush = at_us

        def prune(us):
            # Only entries within the lateness can stand out of time order, so
            # the left end is dropped and a rescan follows only where one lags
            while buf and buf[0][2] is not None and buf[0][2] < us - win_us:
                leave(buf.popleft(), "pruned", us)
            if disordered and any(b[2] is not None and b[2] < us - win_us for b in buf):
                for b in [b for b in buf if b[2] is not None and b[2] < us - win_us]:
                    buf.remove(b)
                    leave(b, "pruned", us)

        if state.hasTimedOut:
            if buf:
                emit("shutdown", max_us)
        else:
            entries, orphans = _fold(pd.concat(list(pdfs), ignore_index=True))
            for row in orphans.itertuples(index=False):
                leave((row.file, int(row.line_no), None, None, row.line), "orphan", None)
            entries = entries.sort_values(["sort_us", "file", "entry_no"], kind="stable", na_position="first")
            if interval_us is None and max_entries is None and len(entries):
                left, buf, flush_no, last_flush, max_us = _replay(entries, list(buf), flush_no, last_flush, max_us,
                                                                  win_us, late_us)
                entries = entries.iloc[:0]
            for row in entries.itertuples(index=False):
                us = None if pd.isna(row.us) else int(row.us)
                entry = (row.file, int(row.entry_no), us, row.level, row.message)
                if us is not None and max_us is not None and us < max_us - late_us:
                    leave(entry, "late", us)
                    continue
                if us is None or (max_us is not None and us < max_us):
                    disordered = True  # the buffer is no longer in time order
                if us is not None:
                    max_us = us if max_us is None else max(max_us, us)
                    prune(us)
                    if interval_us is not None and buf and last_flush is not None and us - last_flush >= interval_us:
                        emit("time_elapsed", us)
                    if last_flush is None:
                        last_flush = us
                if row.level in CONTROL:
                    if buf:
                        emit(CONTROL[row.level], us if us is not None else max_us)
                    continue
                buf.append(entry)
                while max_entries is not None and len(buf) > max_entries:
                    leave(buf.popleft(), "overflow", us)
                if row.level == "ERROR":
                    disordered = False
                    emit("error_detected", us if us is not None else max_us)

        state.update((flush_no, last_flush, max_us, [b[0] for b in buf], [b[1] for b in buf],
                      [b[2] for b in buf], [b[3] for b in buf], [b[4] for b in buf]))
        if buf and idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        for first in range(0, len(out), OUTPUT_ROWS):
            df = pd.DataFrame(out[first:first + OUTPUT_ROWS], columns=["source_id", "flush_no", "reason", "flushed_at",
                                                                       "file", "entry_no", "ts", "level", "message"])
            for c in ("flushed_at", "ts"):
                df[c] = pd.to_datetime(df[c], unit="us")
            yield df
        for first in range(0, 0 if left is None else len(left), OUTPUT_ROWS):
            df = left.iloc[first:first + OUTPUT_ROWS].reset_index(drop=True)
            df.insert(0, "source_id", source)
            yield df

    return fn


def stream_flush(lines: DataFrame, window_seconds: int = 60, flush_interval_seconds: int | None = None,
                 max_entries: int | None = None, allowed_lateness: str = "60 seconds", idle: str | None = None) -> DataFrame:
    """Streaming lines ``(source_id, file, line_no, line)`` -> entries with
    their flush number (-1 where they leave outside a flush) and reason."""
    fn = make_flush_fn(window_seconds, flush_interval_seconds, max_entries,
                       allowed_lateness_seconds=_seconds(allowed_lateness), idle_ms=1000 * _seconds(idle) if idle else None)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return (prepare_lines(lines).select("source_id", "file", "line_no", "line", "is_head", "ts", "level")
            .groupBy("source_id")
            .applyInPandasWithState(fn, OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout))


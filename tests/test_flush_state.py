"""T1/T2 replay logic of the flush state function, driven directly with a
stub GroupState (fast, no stream)."""

import pandas as pd

from tracefold.streaming.flush import make_flush_fn


class StubState:
    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def lines(rows):
    """rows: (line_no, second or None, level or None, text); file 'f'."""
    recs = []
    for n, sec, lvl, text in rows:
        head = sec is not None or lvl in ("FLUSH", "SHUTDOWN")
        recs.append({"source_id": "s", "file": "f", "line_no": n, "line": text, "is_head": head,
                     "ts": None if sec is None else pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=sec),
                     "level": lvl})
    return pd.DataFrame(recs)


def run(fn, state, batch):
    out = list(fn(("s",), iter([batch]), state))
    return pd.concat(out) if out else pd.DataFrame(columns=["reason", "flush_no", "entry_no"])


def test_error_flush_prune_and_fold():
    fn = make_flush_fn(window_seconds=60)
    st = StubState()
    out = run(fn, st, lines([(1, 0, "INFO", "a"), (2, 100, "WARNING", "b"), (3, None, None, "  at x"),
                             (4, 130, "ERROR", "c"), (5, 131, "ERROR", "d")]))
    got = list(zip(out["flush_no"], out["entry_no"], out["reason"]))
    assert got.pop(0) == (-1, 1, "pruned")
    # entry 1 is pruned (older than 60 s before entry 2); entry 2 folds line 3
    assert got == [(0, 2, "error_detected"), (0, 4, "error_detected"), (1, 5, "error_detected")]
    assert out[out["entry_no"] == 2]["message"].iloc[0] == "b\n  at x"
    assert st.value[0] == 2 and st.value[3] == []


def test_interval_manual_and_late():
    fn = make_flush_fn(window_seconds=60, flush_interval_seconds=30, allowed_lateness_seconds=60)
    st = StubState()
    out = run(fn, st, lines([(1, 0, "INFO", "a"), (2, 10, "INFO", "b"), (3, 45, "INFO", "c"),
                             (4, None, "FLUSH", "FLUSH"), (5, 50, "INFO", "e")]))
    assert list(out["reason"]) == ["time_elapsed", "time_elapsed", "manual"]   # a,b at 45 s; c by hand
    assert list(run(fn, st, lines([(6, 200, "INFO", "f")]))["reason"]) == ["pruned"]
    out3 = run(fn, st, lines([(7, 20, "INFO", "late one")]))                 # behind the newest by > 60 s
    assert list(out3["reason"]) == ["late"] and out3["entry_no"].iloc[0] == 7
    assert [e for e in st.value[4]] == [6]                                   # e pruned, f buffered


def test_timeout_gives_the_buffer_out():
    fn = make_flush_fn(window_seconds=60, idle_ms=1000)
    st = StubState()
    run(fn, st, lines([(1, 0, "INFO", "a")]))
    assert st.exists and st.timeout
    st.hasTimedOut = True
    out = pd.concat(list(fn(("s",), iter([]), st)))
    assert list(out["reason"]) == ["shutdown"] and st.value[0] == 1 and st.value[3] == []


def test_every_line_leaves_once():
    import random
    rnd = random.Random(4)
    for trial in range(40):
        fn = make_flush_fn(window_seconds=30, allowed_lateness_seconds=20, max_entries=rnd.choice([None, 3]))
        st, seen, n, now = StubState(), [], 0, 100
        for _ in range(4):
            rows = []
            for _ in range(rnd.randint(1, 12)):
                n += 1
                kind = rnd.random()
                if kind < 0.2:
                    rows.append((n, None, None, "  at frame"))
                else:
                    now += rnd.randint(0, 12)
                    rows.append((n, now - rnd.choice([0, 0, 0, 15, 60]), "ERROR" if kind > 0.9 else "INFO", f"e{n}"))
            batch = lines(rows)
            out = run(fn, st, batch)
            seen += [(int(e), m) for e, m in zip(out.get("entry_no", []), out.get("message", []))]
        n += 1
        end = run(fn, st, lines([(n, None, "SHUTDOWN", "SHUTDOWN")]))
        seen += [(int(e), m) for e, m in zip(end.get("entry_no", []), end.get("message", []))]
        assert not st.value[3]
        # every line is in exactly one entry, behind its own head
        got = [e + k for e, m in seen for k in range(len(m.split("\n")))]
        assert sorted(got) == list(range(1, n))


def test_an_entry_without_a_time_keeps_no_older_one():
    """A batch that left one entry without a time in the buffer: later entries are pruned as ever."""
    fn = make_flush_fn(window_seconds=60)
    st = StubState()
    untimed = lines([(1, None, None, "x")]).assign(is_head=True, level="INFO", ts=pd.NaT)
    run(fn, st, untimed)
    out = run(fn, st, lines([(2, 0, "INFO", "a"), (3, 100, "INFO", "b"), (4, 110, "ERROR", "c")]))
    assert sorted(zip(out["entry_no"], out["reason"])) == [(1, "error_detected"), (2, "pruned"), (3, "error_detected"),
                                                           (4, "error_detected")]

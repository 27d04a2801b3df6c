"""Plain Python versions of the training-data operators, for the tests."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, length=200):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) for (doc_id, text) rows."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(r[k:k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        hit = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if starts[r[k:k + length]] > 1:
                hit[k:k + length] = b"\1" * length
        rest = bytes(c for c, h in zip(r, hit) if not h)
        out.append((i, len(r), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(rest).hexdigest()))
    return out


def shingle_set(text, width):
    words = GAP.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def near_groups(rows, width, percent=80):
    """doc_id -> smallest doc_id reachable over links, for rows with distinct ids."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            inverted[x].add(i)
    for a, s in sets.items():
        near = Counter(b for x in s for b in inverted[x] if b > a)
        for b, common in near.items():
            if 100 * common >= percent * (len(s) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def strip(rows, length=200):
    """doc_id -> text without the bytes of repeated strings, for distinct ids."""
    raws = {i: (t or "").encode() for i, t in rows}
    starts = Counter(r[k:k + length] for r in raws.values() for k in range(len(r) - length + 1))
    out = {}
    for i, r in raws.items():
        hit = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if starts[r[k:k + length]] > 1:
                hit[k:k + length] = b"\1" * length
        out[i] = bytes(c for c, h in zip(r, hit) if not h).decode("utf-8", "ignore")
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def resampled(rows, target, buckets=10000, orders=1, share=(10, 100), min_words=20):
    """Sorted (id, n_features, weight, score, rank) of (id, text) rows."""
    def features(text):
        ws = WORD.findall(ascii_lower(text))
        return [" ".join(ws[i:i + n]) for n in range(1, orders + 1) for i in range(len(ws) - n + 1)], len(ws)

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in rows for f in features(t)[0])
    t = Counter(bucket(f) for x in target for f in features(x)[0])
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, text in rows:
        fs, n = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((o for o in out if o[4] >= min_words), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    drawn = {id(o): n for n, o in enumerate(able[:share[0] * len(able) // share[1]], 1)}
    return sorted(((*o[:4], drawn.get(id(o))) for o in out), key=str)


def ranked(docs, items, k=10):
    """(item, rank, id, score) rows by scoring every document."""
    bags = [(i, Counter(WORD.findall(ascii_lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * b[w] // (1000 * b[w] + 8 * m))
                        for w in WORD.findall(ascii_lower(text)) if w in b)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out.extend((item, r, x[2], -x[0]) for r, x in enumerate(scored[:k], 1))
    return sorted(out, key=str)

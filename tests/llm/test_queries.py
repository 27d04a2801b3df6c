"""The registered training-data queries on the small tables: against DuckDB where
SQL can say the same, else against brute force."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_oracle import digest  # noqa: E402
from tracefold.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = Q.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(Q.oracle_sql()[name])
    columns, expected = [d[0] for d in cur.description], cur.fetchall()
    assert rows and sorted(df.columns) == sorted(columns)
    assert digest(rows, df.columns) == digest(expected, columns)


def documents(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def test_substring_dedup_against_all_windows(spark, con):
    got = [tuple(r) for r in Q.queries()["op3_suffix_dedup"](spark, SF).collect()]
    expected = brute.repeats(documents(con))
    assert sorted(got) == sorted(expected) and any(r[2] for r in expected)


def check_packing(rows, texts, capacity=2048):
    """Ids, cuts and gapless sequences of packed pieces, against whole encodings."""
    import zlib
    from array import array

    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(Q.tokenizer_path())
    seen, places, total = {}, {}, 0
    for doc, piece, start, length, crc, seq, offset in rows:
        seen.setdefault(doc, []).append((piece, start, length, crc))
        places.setdefault(seq, []).append((offset, length))
    assert sorted(seen) == sorted(i for i, _ in texts)
    for doc, text in texts:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        parts = sorted(seen[doc])
        assert [p[0] for p in parts] == list(range(len(parts)))
        for n, (_, start, length, crc) in enumerate(parts):
            assert start == at and zlib.crc32(array("I", ids[at:at + length]).tobytes()) == crc
            assert length == capacity if n else length <= capacity
            at += length
        assert at == len(ids)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-total // capacity)


def test_packing_round_trip(spark, con):
    rows = [tuple(r) for r in Q.queries()["op7_packing"](spark, SF).collect()]
    used, least = check_packing(rows, documents(con))
    assert used <= least + 1 + least // 100


def test_extraction_against_markup(spark, con):
    import html
    import re
    got = {r[0]: (r[2], r[3]) for r in Q.queries()["op8_html_extraction"](spark, SF).collect()}
    for page, raw in con.execute("SELECT page_id, html FROM pages").fetchall():
        inner = re.search(r"<article>(.*?)</article>", raw, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        text = "\n\n".join(b for b in blocks if b)
        assert got[page] == (text, len(text))


def test_pipeline_against_brute_force(spark, con):
    """Every stage on what its predecessor kept, each by its plain version."""
    c = duckdb.connect()
    c.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    c.execute(f"CREATE TABLE a AS SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({Q.quality_sql()}) WHERE kept)")
    groups = brute.near_groups(c.execute("SELECT doc_id, text FROM a").fetchall(), 5)
    firsts = [i for i, (_, root) in groups.items() if i == root]
    c.execute("CREATE TABLE b AS SELECT * FROM a WHERE list_contains(?, doc_id)", [firsts])
    kept = brute.strip(c.execute("SELECT doc_id, text FROM b").fetchall())
    c.execute("CREATE TABLE d AS SELECT b.* REPLACE (k.text AS text) FROM b JOIN "
              "(SELECT unnest(?) AS doc_id, unnest(?) AS text) k USING (doc_id)", [list(kept), list(kept.values())])
    texts = c.execute(f"SELECT doc_id, text FROM d WHERE doc_id IN (SELECT doc_id FROM ({Q.mixing_sql('d')}) WHERE kept)").fetchall()
    assert 0 < len(texts) < c.execute("SELECT count(*) FROM d").fetchone()[0] < len(groups)
    rows = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    used, least = check_packing(rows, texts)
    assert used <= least + 1 + least // 100

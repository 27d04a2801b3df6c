"""op10 on full licence texts and on many long templates, against its SQL definition."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracefold.llm import license_scan
from tracefold.llm import queries as Q


def mutated(rng, text, share):
    return " ".join(rng.choice("abcd") * 3 if rng.random() < share else w for w in text.split())


def against_sql(spark, rows, templates=license_scan.TEMPLATES):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(df.withColumn("x", F.lit(1)).withColumn("h", F.lit(2)).withColumn("key", F.lit(3)).withColumn(
        "start", F.lit(4)).withColumn("template", F.lit("t")), templates=templates)
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", rows)
    cur = con.execute(Q.license_sql(templates, "docs"))
    names = [d[0] for d in cur.description]
    rounded = got.withColumn("containment", F.round("containment", 6)).select(*names)
    out = sorted(map(tuple, rounded.collect()))
    assert out == sorted(cur.fetchall())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_full_texts_whole_damaged_and_within_long_texts(spark, seed):
    rng = random.Random(seed)
    names = list(license_scan.TEMPLATES)
    rows = []
    for i in range(60):
        body = license_scan.TEMPLATES[rng.choice(names)]
        parts = [mutated(rng, body, rng.choice([0, 0, 0.01, 0.03, 0.05, 0.2]))]
        for side in (0, -1):
            parts.insert(side or 0, " ".join(rng.choice(["the", "of", "license", "software"]) for _ in range(rng.randint(0, 70))))
        rows.append((i, "\n".join(parts)))
    rows.append((100, "word " * 600 + license_scan.TEMPLATES["BSD-3-Clause"] + " word" * 300))
    out = against_sql(spark, rows)
    assert (100, "BSD-3-Clause") in {r[:2] for r in out}
    assert len({r[1] for r in out}) > 8 and any(r[2] < 1 for r in out)


def test_many_long_templates(spark):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(900)]
    templates = {f"T{i}": " ".join(rng.choice(voc) for _ in range(rng.choice([3, 40, 700]))) for i in range(120)}
    rows = [(i, f"{'pre ' * rng.randint(0, 9)}{mutated(rng, templates[f'T{i}'], 0.01)} post") for i in range(0, 120, 3)]
    out = against_sql(spark, rows, templates)
    assert len({r[0] for r in out}) > 30


def test_very_long_text(spark):
    text = "word " * 60000 + license_scan.TEMPLATES["BSD-3-Clause"] + " word" * 30000
    got = license_scan.scan(spark.createDataFrame([("a", text)], "doc_id string, text string")).collect()
    assert ("a", "BSD-3-Clause", 60000) in {(r["doc_id"], r["template"], r["first_word"]) for r in got}


def test_template_bound():
    with pytest.raises(ValueError):
        license_scan.template_table(None, {str(i): "a" for i in range(license_scan.MAX_TEMPLATES + 1)})

"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from larkspur.plans import catalog as queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted(repr(canon([r[names.index(c)] for c in cols])) for r in got.fetchall())
    assert sorted(repr(canon([r[c] for c in cols])) for r in df.collect()) == want


def test_lookup_asks_by_whole_texts(spark, sf):
    token = re.compile(r"[^\W_]+")
    docs = {r.doc_id: Counter(token.findall(r.text.lower())) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    docs = {k: c for k, c in docs.items() if c}
    df, mean = Counter(w for c in docs.values() for w in c), sum(c.total() for c in docs.values()) / len(docs)
    got = {r.item_id: (r.doc_id, r.score) for r in queries.QUERIES["J10_lookup"](spark, sf).collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    for item in items:
        words = token.findall(item.text.lower())
        scored = {k: sum(n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w, n in Counter(words).items() if w in c) for k, c in docs.items()}
        best = min(scored, key=lambda k: (-round(scored[k], 6), k))
        assert got[item.item_id] == (best, pytest.approx(scored[best], abs=1e-4))
    assert len(got) == len(items)


def test_whole_vectors(spark, sf):
    rows, groups = spark.read.parquet(f"{sf}/embeddings.parquet").collect(), {}
    for r in rows:
        groups.setdefault(r.label, []).append(r.embedding)
    assert {r.label: r.v for r in queries.QUERIES["A02_vector_max"](spark, sf).collect()} == {k: [max(x) for x in zip(*g, strict=True)] for k, g in groups.items()}
    centres = {k: [math.fsum(x) / len(g) for x in zip(*g, strict=True)] for k, g in groups.items()}
    cosine = lambda a, b: math.sumprod(a, b) / math.hypot(*a) / math.hypot(*b)
    want = {r.vec_id: min(centres, key=lambda k: (-round(cosine(r.embedding, centres[k]), 9), k)) for r in rows}
    assert {r.vec_id: r.centre for r in queries.QUERIES["J14_nearest_centre"](spark, sf).collect()} == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 40
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0

"""Every SQL twin agrees with its Spark plan on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEAVY = {"tfidf_weights", "term_contributions"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(None if r[i] is None or r[i] is pd.NaT else (round(r[i], 6) if isinstance(r[i], float) else str(r[i])) for i in order))
    return sorted(out, key=repr)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["risk_level", "mails", "avg_probability"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - HEAVY))
def test_twin(spark, sf, con, name):
    got = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    want_cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(want_cols)
    assert _norm([tuple(r) for r in got.collect()], got.columns) == _norm(cur.fetchall(), want_cols)

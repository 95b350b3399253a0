"""Registered queries against their SQL on the smallest tables (a sample of cheap ones; all run in the driver's gate)."""

import collections
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
NAMES = ["top_hubs", "degrees", "ccdf", "reciprocity", "friend_gap", "turn_network", "talk_lift", "distinctive_terms", "flows", "nmi", "extract_attributes", "variant_counts", "variant_top", "pair_similarities"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from netlex.plans import registry

    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "documents", "conversations", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    norm = lambda v: round(float(v), 6) if isinstance(v, float) else v
    ours = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(registry.SQL[name])
    theirs = collections.Counter(tuple(norm(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    assert ours == theirs


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

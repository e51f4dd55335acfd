"""Every query against its SQL on the smallest tables; queries without SQL by their own rules."""

import os

import duckdb
import pandas as pd
import pytest

from siltstone.operators.objects import zero_runs
from siltstone.plans import catalog
from siltstone.sources.fixtures import Repo

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or x is pd.NaT:
        return ""
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    out = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


def test_sparse_regions(spark):
    want = {(r["hash"], i, s, n) for r in Repo(spark, SF).payloads.collect() for i, (s, n) in enumerate(zero_runs(bytes(r["payload"]).replace(b"\n", b"\0" * 8), 8))}
    assert {tuple(r) for r in catalog.QUERIES["sparse_regions"](spark, SF).collect()} == want


def test_incompressible(spark):
    rows = catalog.QUERIES["incompressible"](spark, SF).collect()
    assert len(rows) == Repo(spark, SF).objects.count() and all(0 < r.ratio <= 1 and r["skip"] == (r.ratio >= 0.9) for r in rows)

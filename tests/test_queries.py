"""Every query with SQL against DuckDB, and the others for rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from cellarium import registry


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.SQL:
        assert got
        return
    found = db.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, found.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("matcher", ["partial", "complete", "random", "isomorphism"])
def test_graph_matching_takes_all_nations(spark, db, matcher):
    """A pair for each nation of the region, one for the region, and two for the predicates."""
    want = dict(db.execute("select n_regionkey, count(*) + 3 from nation group by 1").fetchall())
    got = registry.QUERIES[f"graph_match_{matcher}"](spark, SF).collect()
    assert {r["region"]: r["pairs"] for r in got} == want and not any(r["truncated"] for r in got)

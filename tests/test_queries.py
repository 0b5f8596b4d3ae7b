"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

import landloom.queries as Q

Q.load()
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, str):
        return v
    try:
        return f"{float(v) + 0.0:.7g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, duck, sf, name):
    got, want = Q.QUERIES[name](spark, sf).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_run_summaries_are_read_from_files(spark, sf, monkeypatch):
    from landloom.sources import tables

    read, seen = tables.read_summaries, []
    monkeypatch.setattr(tables, "read_summaries", lambda s, at: seen.append((at, read(s, at))) or seen[-1][1])
    n = Q.QUERIES["s05_run_summaries"](spark, f"{sf}").count()
    (at, found), = seen
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("path").collect()
    assert any("run=broken" in r.path for r in files) and all(r.path.startswith("file:") for r in files)
    good = [r.path for r in found.filter("s_acctbal is not null").select("path").collect()]
    assert len(good) == n > 0 and not any("run=broken" in p for p in good)

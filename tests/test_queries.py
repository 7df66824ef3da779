"""Every query runs and keeps its schema; those with SQL agree with it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

OUR = [q for q in entry.queries() if not q.startswith(("p1_", "p2_", "p3_", "p4_", "p7_", "p8_", "p9_", "p10_"))]


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", OUR)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    assert df.columns
    sql = entry.oracle_sql().get(name)
    assert rows or sql
    if sql:
        got = duck.execute(sql)
        names = [x[0] for x in got.description]
        assert sorted(names) == sorted(df.columns)
        key = lambda r: repr([plain(v) for v in r])
        ours = sorted(([r[c] for c in sorted(df.columns)] for r in rows), key=key)
        theirs = sorted(([r[names.index(c)] for c in sorted(names)] for r in got.fetchall()), key=key)
        assert len(ours) == len(theirs)
        for a, b in zip(ours, theirs, strict=True):
            for x, y in zip(a, b, strict=True):
                assert plain(x) == pytest.approx(plain(y), rel=1e-4) if isinstance(x, float) else plain(x) == plain(y)


def test_entry(spark):
    assert entry.entry(spark).columns == ["pair_id", "kept", "deleted", "inserted"]


def test_stream_counts_and_latest(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from tallyweave.streaming import census

    source = spark.read.parquet(f"{sf}/candidates.parquet")
    folder = str(tmp_path / "in")
    source.write.parquet(folder)
    stream = census.arriving(spark, folder, source.schema)
    q = census.census_stream(stream, "sampled_at", F.col("language")).writeStream.format("memory").queryName("c").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("c").agg(F.sum("changes")).first()[0] == source.count()
    w = census.keep_latest(stream.select("path", "seq"), str(tmp_path / "t"), ["path"], "seq").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    w.awaitTermination()
    last = sorted(os.listdir(tmp_path / "t"))[-1]
    assert spark.read.parquet(str(tmp_path / "t" / last)).count() == source.select("path").distinct().count()

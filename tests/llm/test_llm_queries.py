"""The registered queries of the subpackage run, and agree with their SQL."""

import os

import duckdb
import pytest

from tallyweave.llm import catalog


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat()[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.SQL:
        c = duckdb.connect()
        c.execute("set timezone = 'UTC'")
        for f in os.listdir(sf):
            c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
        got = c.execute(catalog.SQL[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == sorted(df.columns)
        ours = sorted(([plain(r[df.columns.index(c)]) for c in sorted(names)] for r in rows), key=repr)
        theirs = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in got.fetchall()), key=repr)
        assert ours == theirs

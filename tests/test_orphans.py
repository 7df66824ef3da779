"""References to records that do not exist."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tallyweave.operators import orphans as O

DAY = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(n):
    return None if n is None else DAY + timedelta(hours=n)


def brute(refs, parents, width):
    out = []
    for r in refs:
        key, t = r[1 : 1 + width], r[-1]
        if None in key or t is None:
            continue
        if not any(p[:width] == key and p[width] is not None and p[width] <= t and (p[width + 1] is None or t < p[width + 1]) for p in parents):
            out.append(r[0])
    return sorted(out)


@pytest.mark.parametrize("part_rows", [400_000, 40])
def test_against_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(O, "PART_ROWS", part_rows)
    rng = random.Random(part_rows)
    name = lambda: rng.choice(["hot"] * 5 + ["a", "b", "c", "", None])
    hour = lambda: rng.choice([None, *range(12)])
    parents = [(name(), rng.choice(["x", "y", None]), at(hour()), at(hour())) for _ in range(160)] + [("never", "x", at(5), at(5))]
    refs = [(i, name(), rng.choice(["x", "y", "z", None]), at(hour())) for i in range(400)] + [(500, "never", "x", at(5)), (501, "a", "x", at(3)), (501, "a", "x", at(3))]
    p = spark.createDataFrame(parents, "k string, c string, since timestamp, until timestamp")
    r = spark.createDataFrame(refs, "id bigint, k string, c string, t timestamp").withColumnRenamed("t", "since")
    got = O.orphan_references(r, "id", "since", p, ["k", "c"], "since", "until", "p")
    assert sorted(x.id for x in got.collect()) == brute(refs, parents, 2)
    one = O.orphan_references(r, "id", "since", p, ["k"], "since", None, "p")
    flat = [(i, k, t) for i, k, _, t in refs]
    assert sorted(x.id for x in one.collect()) == brute(flat, [(k, s, None) for k, _, s, _ in parents], 1)


def test_bounds_are_half_open(spark):
    p = spark.createDataFrame([("a", at(1), at(3))], "k string, s timestamp, e timestamp")
    r = spark.createDataFrame([(h, "a", at(h)) for h in range(5)], "id int, k string, t timestamp")
    assert sorted(x.id for x in O.orphan_references(r, "id", "t", p, ["k"], "s", "e").collect()) == [0, 3, 4]


def test_empty_tables(spark):
    p = spark.createDataFrame([], "k string, s timestamp")
    r = spark.createDataFrame([(1, "a", at(1)), (2, None, at(1))], "id int, k string, t timestamp")
    assert [x.id for x in O.orphan_references(r, "id", "t", p, ["k"], "s").collect()] == [1]
    assert O.orphan_references(r.limit(0), "id", "t", p, ["k"], "s").count() == 0


def test_probe_tells_keys_of_one_hash_apart():
    a = lambda *x: np.array(x, np.int64)
    parents = {"h1": a(7, 7, 7), "h2": a(1, 2, 2), "start": a(0, 5, 1), "end": a(4, 9, 2)}
    refs = {"h1": a(7, 7, 7, 7, 8), "h2": a(1, 2, 2, 3, 1), "time": a(3, 3, 6, 3, 3)}
    assert O.probe(parents, refs).tolist() == [True, False, True, False, False]

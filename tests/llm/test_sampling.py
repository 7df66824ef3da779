"""Reservoirs, percentiles and mixing."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import mixing as M
from tallyweave.llm import percentiles as P
from tallyweave.llm import reservoir as R
from tallyweave.llm.tokens import with_token_counts


def test_counts_are_conserved():
    rng = np.random.default_rng(0)
    for k in (1, 5, 40):
        offered = rng.integers(0, 6, (7, 4))
        kept = R.survivors_per_cell(offered, k, rng)
        assert (kept <= offered).all() and (kept >= 0).all() and kept.sum() == min(k, offered.sum())


def test_every_batch_has_its_share():
    offered = np.array([[3, 1], [0, 0], [20, 16]])
    total = sum(R.survivors_per_cell(offered, 8, R.generator(s)) for s in range(4000)) / 4000
    assert np.abs(total - 8 * offered / 40).max() < 0.12


def test_draws_from_any_population(monkeypatch):
    """Inversion has the law of the definition, and its mean and deviation where numpy can't go."""
    rng = np.random.default_rng(4)
    exact = [math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20) for k in range(21)]
    monkeypatch.setattr(R, "NUMPY_POPULATION", 0)
    hits = Counter(R.hypergeometric(rng, 30, 70, 20) for _ in range(20_000))
    likely = [k for k in range(21) if exact[k] > 0.001]
    assert sum((hits[k] - 20_000 * exact[k]) ** 2 / (20_000 * exact[k]) for k in likely) < 40
    monkeypatch.undo()
    draws = np.array([R.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(400)])
    assert abs(draws.mean() - 250_000) < 5 * 433 / 20 and 380 < draws.std() < 490
    nearly_all = np.array([R.hypergeometric(rng, 10**10, 10**4, 10**10) for _ in range(50)])  # all but 10,000 drawn
    assert abs(nearly_all.mean() - (10**10 - 10**4)) < 1 and nearly_all.std() < 1  # a binomial's would be 100
    kept = R.survivors_per_cell(np.array([[4 * 10**9, 4 * 10**9], [10**9, 10**9], [0, 1]]), 1_000_000, rng)
    assert kept.sum() == 1_000_000 and abs(kept[0].sum() - 800_000) < 2500


def test_each_record_is_equally_likely(spark):
    """Four hundred strata of the same sixty records are four hundred independent samples."""
    pairs = spark.range(400 * 60).select(F.floor(F.col("id") / 60).alias("g"), (F.col("id") % 60).alias("item"), (F.col("id") % 60 > 50).cast("int").alias("batch"))
    rows = R.reservoirs(pairs, ["g"], "item", "batch", 12, slots=3).collect()
    assert len(rows) == 400 and all(r.seen == 60 and len(set(r["items"])) == 12 for r in rows)
    seen = Counter(x for r in rows for x in r["items"])
    expected = 400 * 12 / 60
    assert sum((seen[i] - expected) ** 2 / expected for i in range(60)) < 110  # chi square, 59 degrees, 0.9999


def test_reservoir_edges(spark):
    rows = [("a", i, None if i % 2 else 3) for i in range(5)] + [(None, 9, 1), ("b", None, 1), ("b", 7, 1), ("b", 7, 1), ("c", 1, 2)]
    df = spark.createDataFrame(rows, "g string, item bigint, _seen bigint")
    got = {r.g: (r.seen, r["items"]) for r in R.reservoirs(df, ["g"], "item", "_seen", 3).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"][0] == 5 and len(got["a"][1]) == 3
    assert got["b"][0] == 3 and got["c"] == (1, [1])
    again = {r.g: (r.seen, r["items"]) for r in R.reservoirs(df.repartition(7), ["g"], "item", "_seen", 3).collect()}
    assert again == got
    assert R.reservoirs(df.limit(0), ["g"], "item", "_seen", 3).count() == 0


REPORT = "g string, piece int, capacity int, seen bigint, items array<bigint>, reported_at timestamp"


def test_merging_reports(spark):
    rows = [("a", 0, 4, 2, [1, 2], None), ("a", 1, 4, 100, [10, 11, 12, 13], None), ("a", 1, 4, 100, [10, 11, 12, 13], None), ("b", 0, 4, 1, [5], None), (None, 0, 4, 1, [6], None), ("b", 1, 4, None, [7], None)]
    df = spark.createDataFrame(rows, REPORT)
    got = {r.g: r for r in R.merged_reservoirs(df, ["g"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].seen == 102 and len(set(got["a"]["items"])) == 4 and got["b"]["items"] == [5]
    many = df.filter("g = 'a'").drop("g").crossJoin(spark.range(300).select(F.col("id").cast("string").alias("g")))
    hits = Counter(x for r in R.merged_reservoirs(many, ["g"]).collect() for x in r["items"])
    assert (hits[1] + hits[2]) / 300 == pytest.approx(4 * 2 / 102, abs=0.06)
    assert max(hits[i] for i in (10, 11, 12, 13)) < 340
    assert R.merged_reservoirs(df.limit(0), ["g"]).count() == 0


def nearest(values, permille):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(len(ordered) * permille / 1000)) - 1]


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_exact_percentiles(spark, kind):
    rng = random.Random(kind)
    special = [0, -5, 2**62, -(2**62)] if kind == "bigint" else [0.0, -1e300, 1e300, 5e-324, float("inf")]
    make = (lambda: rng.choice([rng.randrange(10), rng.randrange(2**50), -rng.randrange(2**60)])) if kind == "bigint" else (lambda: rng.choice([round(rng.lognormvariate(2, 3), 3), 7.0, -rng.random()]))
    rows = [(rng.choice(["a", "b", None]), rng.choice([make(), make(), None])) for _ in range(300)] + [("s", v) for v in special] + [("one", special[1]), ("none", None)]
    if kind == "double":
        rows += [("a", float("nan"))] * 5
    df = spark.createDataFrame(rows, f"n string, value {kind}")
    got = {(r.n_, r.permille): r.value for r in P.exact_percentiles(df.withColumnRenamed("n", "n_"), ["n_"], "value", [0, 1, 250, 500, 999, 1000]).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert got == {(g, p): nearest(v, p) for g, v in groups.items() for p in (0, 1, 250, 500, 999, 1000)}
    assert P.exact_percentiles(df.limit(0), ["n"], "value").count() == 0


def test_combined_shards_are_within_the_error(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.choice([rng.lognormvariate(3, 2), 0.0, -rng.random(), None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, shard int, v double")
    days = [P.shard_counts(df.filter(f"shard = {s}"), ["g", "shard"], "v", 0.02) for s in range(4)]
    whole = days[0].unionByName(days[1]).unionByName(days[2]).unionByName(days[3])
    for r in P.combined_percentiles(whole, ["g"], [100, 500, 990], 0.02).collect():
        true = nearest([v for g, _, v in rows if g == r.g and v is not None], r.permille)
        assert r.low - 1e-9 <= true <= r.high + 1e-9 and abs(r.value - true) <= 0.0201 * abs(true)


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, rng.choices(["big", "mid", "small", "extra", None], [60, 25, 6, 4, 5])[0], rng.randrange(1, 400)) for i in range(6000)] + [(7000, "big", 0), (7001, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 9)], TARGETS)
    mixed = M.mixture(docs, targets).cache()
    got = {r.source: r for r in M.shares(mixed, targets).collect()}
    for s, share in (("big", 4 / 9), ("mid", 3 / 9), ("small", 2 / 9)):
        assert got[s].actual_share == pytest.approx(share, abs=0.003)
        assert got[s].most_copies <= got[s].max_repeats
    assert got["absent"].tokens == 0 and mixed.filter("source = 'extra'").count() == 0
    mean = {s: np.mean([t for _, x, t in rows if x == s and t]) for s in ("big", "mid")}
    for s in mean:
        r = mixed.filter(F.col("source") == s).agg((F.sum(F.col("copies") * F.col("n_tokens")) / F.sum("copies")).alias("m")).first()
        assert r.m == pytest.approx(mean[s], rel=0.02)  # lengths aren't favoured
    smaller = M.mixture(docs, targets, total=50_000)
    assert smaller.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] == pytest.approx(50_000, rel=0.03)


def test_token_constraints_tilt_the_rates(spark):
    """The rates are those of the dual, solved here by bisection; copies follow them, and shares hold."""
    rng = random.Random(8)
    rows = [(i, rng.choices(["big", "mid", "small"], [60, 30, 10])[0], int(rng.lognormvariate(4, 1)) + 1) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    share, cap = {"big": 0.2, "mid": 0.5, "small": 0.3}, {"big": 1, "mid": 2, "small": 3}
    mixed = M.mixture(docs, spark.createDataFrame([(s, share[s], cap[s]) for s in share], TARGETS), hold_size=False)
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    size = {s: np.array([t for _, x, t in rows if x == s], float) for s in share}
    aim = min(cap[s] * size[s].sum() / share[s] for s in share)
    start = aim / sum(t.sum() for t in size.values())
    for s, t in size.items():
        got = np.array([copies.get(i, 0) for i, x, _ in rows if x == s])
        assert (got * t).sum() == pytest.approx(share[s] * aim, rel=0.005) and got.max() <= cap[s]
        low, high = -50.0, 50.0
        for _ in range(200):
            b = (low + high) / 2
            rate = np.minimum(cap[s], start * np.exp(np.minimum(700, b * t / t.mean())))
            low, high = (b, high) if (rate * t).sum() < share[s] * aim else (low, b)
        assert s == "small" or abs(b) > 0.1  # the constraint binds
        long_ = t > np.quantile(t, 0.8)
        for part in (long_, ~long_):
            assert got[part].mean() == pytest.approx(rate[part].mean(), rel=0.05)


def test_hot_sizes_and_edges(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 50)
    docs = spark.createDataFrame([(i % 700, "a" if i % 3 else "b", 10) for i in range(900)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.8, None), ("b", 0.0, 1), (None, 0.5, 1)], TARGETS)
    got = {r.source: r.tokens for r in M.mixture(docs, targets).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")).collect()}
    assert got["b"] == 3000 and got["a"] == pytest.approx(750, abs=20)
    assert M.mixture(docs.limit(0), targets).count() == 0
    assert M.mixture(docs, targets.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "word " * 50_000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df, "text", ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000 and got[5] > 1

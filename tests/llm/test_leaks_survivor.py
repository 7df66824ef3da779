"""Leaked held-out texts, and best rows of repeated pairs."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tallyweave.llm import leaks as L
from tallyweave.llm import survivor as S

WORDS = [f"w{i}" for i in range(90)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, words, edits):
    out = list(words)
    for i in sorted(rng.sample(range(len(out)), edits), reverse=True):
        kind = rng.randrange(3)
        out[i : i + 1] = [] if kind == 2 else [f"new{rng.randrange(9)}"] + ([out[i]] if kind else [])
    return out


def repeated_by_definition(item, doc):
    """All sections of the item against all sections of the document, by edit distance."""
    for i in range(len(item) - L.RUN + 1):
        if any(item[i : i + L.RUN] == doc[j : j + L.RUN] for j in range(len(doc) - L.RUN + 1)):
            return True
    for i in range(len(item) - L.SECTION + 1):
        row = [0] * (len(doc) + 1)  # distance of item[i:k] to the best section of the document that ends here
        for k in range(i, len(item)):
            new = [row[0] + 1]
            for j in range(1, len(doc) + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (item[k] != doc[j - 1])))
            row = new
            if k + 1 - i >= L.SECTION and L.EDIT_SHARE * min(row) <= k + 1 - i:
                return True
    return False


def test_exact_check_against_the_definition():
    rng = random.Random(3)
    for trial in range(120):
        item = text(rng, 45).split()
        a = rng.randrange(0, 20)
        doc = text(rng, 6).split() + edited(rng, item[a : a + rng.choice([11, 23, 24, 25, 30])], rng.randrange(0, 7)) + text(rng, 6).split()
        ids = {w: k for k, w in enumerate(dict.fromkeys(item + doc))}
        got = L.repeats(np.array([ids[w] for w in item]), np.array([ids[w] for w in doc]))
        assert got == repeated_by_definition(item, doc), trial


def test_search_finds_what_the_check_accepts():
    rng = random.Random(5)
    items = [(i, text(rng, 70)) for i in range(25)]
    index = L.Index(items)
    docs = []
    for _ in range(400):
        words = items[rng.randrange(25)][1].split()
        a = rng.randrange(0, len(words) - 24)
        docs.append(" ".join([text(rng, 10), *edited(rng, words[a : a + 24], 4), text(rng, 10)]))
    full = []
    for k, d in enumerate(docs):
        own = np.array([index.vocabulary.get(w, -1) for w in L.words_of(d)])
        full += [(k, i) for i in range(25) if L.repeats(index.words[i], own)]
    got = L.leaks_in(index, docs)
    assert set(got) <= set(full) and len(got) >= 0.98 * len(full) >= 300


def test_table(spark):
    rng = random.Random(9)
    item = text(rng, 60)
    words = item.split()
    rows = [
        (1, item.upper().replace(" ", " - ")), (2, " ".join(words[5:17])), (3, " ".join(words[5:16])), (4, None), (5, ""), (6, " ".join(words[5:17])),
        (7, "x " * 150_000 + item), (8, " ".join(edited(rng, words[:30], 3))), (9, text(rng, 200)),
    ]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "short")], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in L.leaks(docs, items).collect()}
    assert got == {(i, d) for i in (1, 2) for d in (1, 2, 6, 7, 8)}
    assert L.leaks(docs, items.limit(0)).count() == 0
    assert L.leaks(docs.limit(0), items).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, text(rng, 40)) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id bigint, text string")
    held = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in L.leaks(docs, held).collect()}
    monkeypatch.setattr(L, "BLOCK_WORDS", 50)
    monkeypatch.setattr(L, "BATCH_CHARS", 100)
    assert {tuple(r) for r in L.leaks(docs, held).collect()} == whole
    monkeypatch.setattr(L, "PASS_BLOCKS", 2)
    assert {tuple(r) for r in L.leaks(docs, held).collect()} == whole == {(i, i) for i, _ in items}


def test_an_item_longer_than_a_block(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"u{i}" for i in range(700)]
    docs = spark.createDataFrame([(a, " ".join(edited(rng, words[a : a + 24], 3))) for a in range(0, 670, 13)] + [(900, " ".join(words))], "doc_id bigint, text string")
    held = spark.createDataFrame([(1, " ".join(words)), (2, text(rng, 30))], "item_id bigint, text string")
    whole = sorted(tuple(r) for r in L.leaks(docs, held).collect())
    monkeypatch.setattr(L, "BLOCK_WORDS", 150)
    assert sorted(tuple(r) for r in L.leaks(docs, held).collect()) == whole
    assert len(whole) == 53 and len(set(whole)) == 53


T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
H = "0123456789abcdef0123456789abcdef01234567"
SCHEMA = "run_id bigint, repository string, commit string, path string, status string, elapsed_ms double, ast_nodes_before bigint, ast_nodes_after bigint, peak_memory_bytes bigint, measured_at timestamp, n_rows string"


def row(i, repository="r", commit=H, path="a/b", status="ok", n=4, when=0):
    return (i, repository, commit, path, status, *[1.0 if n > 0 else None, *(1 if n > k else None for k in (1, 2, 3))], None if when is None else T0 + timedelta(hours=when), "x")


@pytest.mark.parametrize("spelling", ["R", " r", "r/", "r.git", "R.Git/", "r.git/ ", "./r"])
def test_repository_spellings(spark, spelling):
    df = spark.createDataFrame([row(1), row(2, repository=spelling)], SCHEMA)
    assert [tuple(r) for r in S.best_of_repeated(df).collect()] == [(1, 2)]


@pytest.mark.parametrize(("path", "same"), [("./a/b", True), ("a//b", True), ("a\\b", True), ("a/./b", True), ("a/x/../b", True), ("/a/b", True), ("a/B", False), ("b", False), ("../a/b", False)])
def test_path_spellings(spark, path, same):
    df = spark.createDataFrame([row(1), row(2, path=path)], SCHEMA)
    assert S.best_of_repeated(df).count() == int(same)


def test_hashes(spark):
    other = H[:-1] + "8"
    rows = [row(1), row(2, commit=H[:12]), row(3, commit=H.upper()), row(4, commit=None), row(5, path="c", commit=H), row(6, path="c", commit=other), row(7, path="c", commit=H[:10]), row(8, path="d", commit=H[:10]), row(9, path="d", commit=H[:10]), row(10, commit=H[:3])]
    got = {tuple(r) for r in S.best_of_repeated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 3), (8, 9)}  # ambiguous and unknown abbreviations stand for themselves


def test_order_of_preference(spark):
    rows = [row(1, status="killed", when=9), row(2, status=None, when=9), row(3, n=2, when=8), row(4, n=3, when=1), row(5, n=3, when=2), row(6, n=3, when=2), row(7, n=3, when=None), row(8, path="z", when=None), row(9, path="z", when=0)]
    assert {tuple(r) for r in S.best_of_repeated(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 6), (8, 9)}


def test_hot_pair_empty_and_clashing(spark):
    rows = [row(i, commit=H[: 40 - i % 5 * 6], when=i) for i in range(1, 400)] + [row(1000, repository="q")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in S.best_of_repeated(df).collect()] == [(1, 399)]
    kept = {r.repository: r.n_rows for r in S.survivors(df).collect()}
    assert kept == {"r": 399, "q": 1}
    assert S.best_of_repeated(df.limit(0)).count() == 0

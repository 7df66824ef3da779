"""Abusive text."""

import random

import pytest

from tallyweave.llm import abuse as A


@pytest.fixture(scope="module")
def seeds():
    return A.train([])


@pytest.mark.parametrize("text", ["You are a w o r t h l e s s i d i o t.", "shut up, you mor\u200bon", "you are such an 1d10t", "You stupid m.o.r.o.n", "FUCK OFF", "fuuuuuck you", "f**k you", "you fucking b1tch", "you аre аn idiоt", "Halt die Fresse, du Arschloch!"])
def test_disguises(seeds, text):
    assert seeds.worst("The parser is fast.\n" + text) > 0.5


@pytest.mark.parametrize("text", ["Kill the child process first.", "The master must not block its slave.", "I was an idiot to write it that way.", "This is a dumb terminal.", "x ** y and a**b", "", None, "Nude is a colour name.", "You are right, thank you."])
def test_strong_words_about_things(seeds, text):
    assert seeds.worst(text) <= 0.5


def test_swapping_the_group_changes_little(seeds):
    scores = [seeds.score(A.words_of(f"we do not need {g} here, they breed like rats")) for g in ("women", "foreigners", "muslims", "christians", "gays")]
    assert min(scores) > 0.5 and max(scores) - min(scores) < 0.1
    fine = [seeds.score(A.words_of(f"{g} are counted in the same column of the survey")) for g in ("women", "jews", "turks", "teenagers")]
    assert max(fine) <= 0.5 and max(fine) - min(fine) < 0.1


def test_labels_teach_new_phrases():
    rng = random.Random(0)
    nouns = "cache queue table frame node panel stack trunk".split()
    fine = lambda: " ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} is {rng.choice(['fast', 'slow', 'new'])}." for _ in range(6))
    bad = lambda: fine() + f"\nI smell burnt porridge whenever you touch the {rng.choice(nouns)}, gnome."
    data = [(fine(), 0) for _ in range(80)] + [(bad(), 1) for _ in range(12)] + [(fine(), 1)] * 2 + [(bad(), 0)]
    model = A.train(data)
    held = [(bad(), 1) for _ in range(10)] + [(fine(), 0) for _ in range(40)]
    assert sum((model.worst(t) > 0.5) == bool(y) for t, y in held) >= 49


def test_table(spark):
    rows = [(1, "You are a stupid idiot."), (2, None), (3, ""), (4, "All good here."), (4, "All good here."), (5, "fine text. " * 20_000 + "You are a stupid idiot.")]
    docs = spark.createDataFrame([(*r, 0.5, "s") for r in rows], "doc_id bigint, text string, score double, source string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (99, 1)], "doc_id bigint, abusive int")
    got = sorted((r.doc_id, r.score > 0.5) for r in A.scored(docs.drop("score"), A.fit_on(docs, labels), ["doc_id"]).collect())
    assert got == [(1, True), (2, False), (3, False), (4, False), (4, False), (5, True)]
    assert A.scored(docs.limit(0), A.fit_on(docs, labels.limit(0)), ["doc_id"]).count() == 0

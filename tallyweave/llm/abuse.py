"""Abusive, hateful or sexually explicit text: a counterfactually regularised sentence classifier.

A document is as abusive as its worst sentence. Sentences are read past disguises (look-alike
letters, digits for letters, spaces, dots and invisible characters between letters, drawn-out
letters) and become n-grams of words and word classes. A logistic model is fitted on a bounded
sample of labelled documents, whose abusive sentence is latent, and on a few plain sentences made
of the bundled words. For sentences that name a group, the score may not change when another group
is named: squared changes are penalised. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import spread
from .abuse_words import ADJECTIVES, CONFUSABLE, FRAMES_BAD, FRAMES_FINE, GROUPS, INSULTS, LEET, SEXUAL, SWEARING, YOU

#: Labelled documents that are fitted on, at most.
MOST_LABELLED = 6_000
BITS = 18
BUCKETS = 1 << BITS
#: Weight of the squared score changes under swaps of group names, and of the squared weights.
SWAP_PENALTY, RIDGE = 2.0, 2e-4
ROUNDS, STEPS = 4, 60
#: Fine sentences that score above this weigh so much more in the next round.
NEARLY, HARD_WEIGHT = 0.15, 30.0
#: A word in at most this share of the fine documents (or in one) is unusual.
RARE_WORD = 0.004
#: Words and sentences that a task remembers; beyond that it starts anew.
MOST_KNOWN = 200_000

_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W\d_]+)?")
_PREFIX = re.compile(r"^[^\S\n]*(?:(?:<[\w-]+>|[>*#/\-]+|(?:todo|nb|note|fixme)[^\S\n]*:)[^\S\n]*){1,2}", re.M)
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-*_]){3,}[^\W_](?![^\W_])")
_GAP = re.compile(r"[ .\-*_]")
_MASKED = re.compile(r"\b([a-z])([*#]{2,})([a-z]*)(?![\w/])")
_CODE_WORD = re.compile(r"(?<![\w./\\-])[\w./\\-]*(?:[A-Za-z0-9]_[A-Za-z0-9]|[/\\])[\w./\\-]*|\b\w+\.(?:py|rs|go|js|ts|c|h|java|json|md)\b")
_SIGN = re.compile(r"[$@!|](?:(?<=\w.)(?=\w)|(?<=[$@])(?<!\w.)(?=[a-z0-9]*[a-z])|(?<=[a-z0-9].)(?=[a-z0-9]*[a-z]))")
_SIGNS = {"$": "s", "@": "a", "!": "i", "|": "i"}


def _squeeze(word: str) -> str:
    """Every run of a letter as one letter."""
    return re.sub(r"(.)\1+", r"\1", word)


KINDS = ("ADJ", "SWEAR", "SEX", "INSULT", "GROUP")
_CLASSES = {w: kind for kind, words in (("ADJ", ADJECTIVES), ("SWEAR", SWEARING), ("SEX", SEXUAL), ("INSULT", INSULTS)) for w in words.split()}
_SQUEEZED = {_squeeze(w): k for w, k in _CLASSES.items() if len(w) > 3}
_YOU = set(YOU.split())
_LEET = {ord(a): b for a, b in zip(*LEET, strict=True)}


class _Plain(dict):
    """One form of each character; accents and invisible characters vanish."""

    def __missing__(self, o: int) -> str | None:
        self[o] = None if unicodedata.category(chr(o)) in ("Cf", "Mn") else chr(o)
        return self[o]


_PLAIN = _Plain({ord(a): b for a, b in zip(*CONFUSABLE, strict=True)})


def _unmask(m: re.Match) -> str:
    """The first known word that a word with masked letters may be; many masked letters hide something anyway."""
    pattern = re.compile(re.escape(m.group(1)) + "." * len(m.group(2)) + re.escape(m.group(3)))
    known = next((w for w in _CLASSES if pattern.fullmatch(w)), None)
    return f" {known} " if known else " MASKED " if len(m.group(2)) > 2 and m.group(3) else " CODE "


def plain(text: str) -> str:
    """Lower case, one form of each character, without accents and invisible characters."""
    return (text if text.isascii() else unicodedata.normalize("NFKD", text).translate(_PLAIN)).lower()


def _undisguise(token: str) -> str:
    """Digits and signs between letters as the letters they look like, drawn-out letters cut short."""
    if any(c.isalpha() for c in token) and any(c in LEET[0] for c in token):
        token = token.translate(_LEET)
    return re.sub(r"(.)\1{2,}", r"\1", token)


class _Words(dict):
    """What a word of plain text is to the model, by the word."""

    def __missing__(self, w: str) -> str:
        if len(self) > MOST_KNOWN:
            self.clear()
        out = w
        if w not in ("CODE", "MASKED"):
            if w.isdigit():
                out = "NUM"
            else:
                out = _undisguise(w)
                if out != w and any(c.isdigit() for c in w) and _class(out) is None:
                    out = w if not w[-1].isdigit() else "CODE"
        self[w] = out
        return out


_words = _Words()


class _Chunks(dict):
    """The words of what stands between blanks: no expression below crosses a blank."""

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) > MOST_KNOWN:
            self.clear()
        text = _SIGN.sub(lambda m: _SIGNS[m.group()], _CODE_WORD.sub(" CODE ", chunk))
        self[chunk] = tuple(_words[w] for w in _WORD.findall(text))
        return self[chunk]


_chunks = _Chunks()


def word_lists(lines: Sequence[str]) -> list[list[str]]:
    """The words of sentences as the model sees them; CODE stands for identifiers and paths, NUM for numbers.

    The expressions run over all sentences at once; none of them crosses a line.
    """
    if not lines:
        return []
    text = "\n".join([plain(s.replace("\n", " ")) for s in lines])
    text = _PREFIX.sub("", text)
    text = _SPACED.sub(lambda m: " " + _GAP.sub("", m.group()) + " ", text)
    if "*" in text or "#" in text:
        text = _MASKED.sub(_unmask, text)
    return [list(chain.from_iterable(map(_chunks.__getitem__, line.split()))) for line in text.split("\n")]


def words_of(sentence: str) -> list[str]:
    return word_lists([sentence])[0]


def _class(word: str) -> str | None:
    if word in _CLASSES:
        return _CLASSES[word]
    squeezed = _squeeze(word)
    if squeezed in _SQUEEZED:
        return _SQUEEZED[squeezed]
    for ending in ("s", "es", "ed", "ing", "er", "ers"):
        if word.endswith(ending) and word[: -len(ending)] in _CLASSES:
            return _CLASSES[word[: -len(ending)]]
    if word[:1] == "a" and word[1:] in _CLASSES and len(word) > 5:  # an article that was spaced like the letters after it
        return _CLASSES[word[1:]]
    if len(word) >= 9:  # words that were written without the space between them
        for w, k in _CLASSES.items():
            if len(w) >= 5 and k != "ADJ" and (word.endswith(w) or word.startswith(w)):
                return k
    return None


def sentences(text: str | None) -> list[str]:
    return [s for s in (p.strip() for p in _SPLIT.split(text)) if s] if text else []


def _hash(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


_EDGE = np.array([_hash("^"), _hash("$")], np.uint64)
#: Odd factors, one for every sort of feature.
_FACTORS = np.array([_hash(f"feature {k}") | 1 for k in range(16)], np.uint64)


class Vocabulary(dict):
    """Numbers of words, and per number the hash of the word and of its class, and its kinds as bits."""

    def __init__(self, groups: frozenset[str]):
        super().__init__()
        self.groups = groups
        self.rows: list[tuple[int, int, int]] = []
        self.table = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def __missing__(self, word: str) -> int:
        kind = "GROUP" if word in self.groups else _class(word) or ("YOU" if word in _YOU else None)
        own = _hash(word)
        self.rows.append((own, _hash("class " + kind) if kind else own, 1 << (*KINDS, "YOU").index(kind) if kind else 0))
        self[word] = len(self.rows) - 1
        return self[word]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.table[0]) < len(self.rows):
            a, b, c = zip(*self.rows, strict=True)
            self.table = (np.array(a, np.uint64), np.array(b, np.uint64), np.array(c, np.uint8))
        return self.table

    def __reduce__(self):
        return (Vocabulary, (self.groups,))


def _spot(keys: np.ndarray, sort: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys * _FACTORS[sort]
        x ^= x >> np.uint64(31)
        x *= _FACTORS[-1]
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


def features(lists: Sequence[Sequence[str]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, bucket) of all features: words, n-grams of words whose classes are known, both ends, and which kinds occur.

    A feature that occurs twice in a sentence counts twice.
    """
    if len(vocabulary) > MOST_KNOWN:
        vocabulary = Vocabulary(vocabulary.groups)
    lengths = np.array([len(x) for x in lists], np.int64)
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    ids = np.fromiter((vocabulary[w] for x in lists for w in x), np.int64, n)
    words, classes, kinds = (t[ids] for t in vocabulary.arrays())
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), lengths)
    rows, spots = [owner], [_spot(words, 0)]
    classed = np.flatnonzero(kinds)
    rows.append(owner[classed])
    spots.append(_spot(classes[classed], 0))
    with np.errstate(over="ignore"):
        run = classes
        for m in (2, 3, 4):
            if n < m:
                break
            run = (run[:-1] ^ (run[:-1] >> np.uint64(29))) * _FACTORS[m] + classes[m - 1 :]
            whole = owner[: n - m + 1] == owner[m - 1 :]
            rows.append(owner[: n - m + 1][whole])
            spots.append(_spot(run[whole], m))
        full = np.flatnonzero(lengths)
        first = (np.cumsum(lengths) - lengths)[full]
        last = first + lengths[full] - 1
        long_ = lengths[full] > 1
        for at, a, b, c in (
            (5, _EDGE[0], classes[first], np.where(long_, classes[np.minimum(first + 1, n - 1)], _EDGE[1])),
            (6, np.where(long_, classes[np.maximum(last - 1, 0)], _EDGE[0]), classes[last], _EDGE[1]),
        ):
            rows.append(full.astype(np.int32))
            spots.append(_spot((a * _FACTORS[7] + b) * _FACTORS[8] + c, at))
    there = np.bitwise_or.reduceat(kinds, first)
    you = there >> len(KINDS) & 1
    for k in range(len(KINDS)):
        has = np.flatnonzero(there >> k & 1)
        rows += [full[has].astype(np.int32)] * 2
        spots += [_spot(np.full(len(has), k + 1, np.uint64), 9), _spot(you[has].astype(np.uint64) + np.uint64(2 * k + 1), 10)]
    only = np.flatnonzero(there == 1 << len(KINDS))
    rows.append(full[only].astype(np.int32))
    spots.append(_spot(np.full(len(only), 1, np.uint64), 11))
    return np.concatenate(rows), np.concatenate(spots)


class _Rows:
    """Sentences as a sparse matrix of buckets, each row scaled to unit length."""

    def __init__(self, lists: Sequence[Sequence[str]], vocabulary: Vocabulary):
        self.n = len(lists)
        self.row, self.column = features(lists, vocabulary)
        self.scale = 1 / np.sqrt(np.maximum(1, np.bincount(self.row, minlength=self.n)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, (g * self.scale)[self.row], BUCKETS)


class Model:
    def __init__(self, weights: np.ndarray, groups: frozenset[str]):
        self.weights, self.groups = weights, groups
        self.vocabulary = Vocabulary(groups)

    def scores(self, lists: Sequence[Sequence[str]]) -> np.ndarray:
        """The score of each sentence; one without words has 0."""
        rows = _Rows(lists, self.vocabulary)
        p = 1 / (1 + np.exp(-np.clip(rows.dot(self.weights[:-1]) + self.weights[-1], -30, 30)))
        return np.where([bool(x) for x in lists], p, 0.0)

    def score(self, words: Sequence[str]) -> float:
        return float(self.scores([words])[0])

    def worst(self, text: str | None) -> float:
        return float(self.scores(word_lists(sentences(text))).max(initial=0.0))


def group_names(lists: Sequence[Sequence[str]]) -> frozenset[str]:
    """Bundled names of groups and what stands in their place in otherwise equal sentences."""
    groups = set(GROUPS.split())
    common = Counter(w for ws in lists for w in set(ws))
    distinct = [x for x in dict.fromkeys(map(tuple, lists)) if len(x) > 4]
    if not distinct:
        return frozenset(groups)
    # A sentence is a polynomial of its words; without one word's term it is the frame of that word.
    number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in distinct for w in ws))}
    names = list(number)
    hashes = np.array([_hash(w) for w in names], np.uint64)
    ids = np.fromiter((number[w] for ws in distinct for w in ws), np.int64)
    lengths = np.array([len(ws) for ws in distinct], np.int64)
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(distinct)), lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(len(powers) - 1, _FACTORS[12]))
        place = powers[np.arange(len(ids)) - first[owner]]
        terms = hashes[ids] * place
        frames = np.add.reduceat(terms, first)[owner] - terms + place * _FACTORS[13]
    fits = np.array([w.isalpha() and not w.isupper() for w in names])[ids]
    for _ in range(2):
        known = np.array([w in groups for w in names])[ids]
        named = np.unique(frames[known & fits])
        new = np.unique(ids[fits & np.isin(frames, named)])
        groups |= {w for w in (names[k] for k in new) if len(w) > 3 and _class(w) is None and common[w] < 0.02 * len(lists) + 20}
    return frozenset(groups)


def _fit(rows: _Rows, y: np.ndarray, weight: np.ndarray, swapped: tuple[_Rows, _Rows] | None) -> np.ndarray:
    w = np.zeros(BUCKETS)
    bias, g_bias, pace = 0.0, 1e-8, np.full(BUCKETS, 1e-8)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows.dot(w) + bias, -30, 30)))
        g = weight * (p - y)
        grad = rows.back(g) + RIDGE * w
        if swapped:
            a, b = swapped
            push = 2 * SWAP_PENALTY * (a.dot(w) - b.dot(w)) / max(1, a.n)
            grad += a.back(push) - b.back(push)
        pace += grad * grad
        w -= 0.5 * grad / np.sqrt(pace)
        g_bias += g.sum() ** 2
        bias -= 0.5 * g.sum() / np.sqrt(g_bias)
    return np.append(w, bias)


def seeds() -> tuple[list[list[str]], list[list[str]]]:
    """Plain abusive and plain fine sentences: every frame with words of its classes, the k-th word with the k-th."""
    lists = {"INSULT": INSULTS.split(), "ADJ": ADJECTIVES.split(), "SWEAR": SWEARING.split(), "SEX": SEXUAL.split(), "GROUP": GROUPS.split()}

    def filled(frames: str) -> list[list[str]]:
        out = []
        for k, frame in enumerate(frames.strip().split("\n")):
            for i in range(6 if any(x in lists for x in frame.split()) else 1):
                out.append([lists[w][(7 * k + 11 * i + j) % len(lists[w])] if w in lists else w for j, w in enumerate(frame.split())])
        return out

    return filled(FRAMES_BAD), filled(FRAMES_FINE)


def train(labelled: list[tuple[str | None, int]]) -> Model:
    """A model from texts with labels 1 or 0. Labels may be wrong now and then; without any, the plain sentences alone are fitted."""
    docs = [word_lists(sentences(t)) for t, _ in labelled]
    bad_docs = [[tuple(w) for w in d] for d, (_, y) in zip(docs, labelled, strict=True) if y == 1]
    fine_docs = [[tuple(w) for w in d] for d, (_, y) in zip(docs, labelled, strict=True) if y == 0]
    seeds_bad, seeds_fine = seeds()
    groups = group_names([w for d in (*bad_docs, *fine_docs) for w in d] + seeds_bad + seeds_fine)
    fine_count = Counter(w for d in fine_docs for w in set(d))
    fine = [w for w in fine_count if w]
    used = Counter(w for d in fine_docs for w in {w for x in d for w in x})  # in how many fine documents a word is
    rare = max(1, int(RARE_WORD * len(fine_docs)))
    vocabulary = Vocabulary(groups)

    def unusual(words: tuple) -> int:
        return sum(used.get(w, 0) <= rare and (w in groups or not w.isupper()) for w in set(words))

    bad_sentences = list(dict.fromkeys(w for d in bad_docs for w in d if w))
    odd = {w: unusual(w) for w in bad_sentences}
    # How often sentences of one make are in documents of either label.
    in_bad, in_fine = (Counter(f for w in x for f in set(_shape(w, groups))) for x in (bad_sentences, fine))

    def rather_fine(words: tuple) -> bool:
        made = _shape(words, groups)
        return max(in_fine[f] for f in made) > max(in_bad[f] for f in made)

    settled = {w for w in bad_sentences if rather_fine(w)}
    model: Model | None = None
    hard: set[tuple] = set()
    for step in range(ROUNDS):
        picked: list[tuple] = []
        doubted: set[tuple] = set()
        if model is not None:
            score = dict(zip(bad_sentences, model.scores(bad_sentences).tolist(), strict=True))
            for d in bad_docs:
                # The abusive sentence is what the model doubts most and what fine documents don't say.
                best = max((w for w in d if w and w not in settled), key=lambda w: score[w] + 0.5 * min(3, odd[w]) / 3, default=None)
                if best and (score[best] > 0.5 or odd[best] >= 2 and score[best] > 0.08):
                    picked.append(best)
            # A sentence of a document that is labelled fine, but close to what is picked elsewhere, is a wrong label.
            high = model.scores(fine) > (0.8 if step == 1 else 0.7)
            shapes = {f for w in picked for f in _shape(w, groups)}
            # One that is in several fine documents, or mostly in such, is fine after all.
            doubted = {w for w, h in zip(fine, high, strict=True) if h and fine_count[w] < 3 and not rather_fine(w) and (step == 1 or any(f in shapes for f in _shape(w, groups)))}
        good = [w for w in fine if w not in doubted]
        lists = seeds_bad + picked + seeds_fine + good
        n_bad = len(seeds_bad) + len(picked)
        y = np.r_[np.ones(n_bad), np.zeros(len(lists) - n_bad)]
        weight = np.where(y == 1, 1.0 / max(1, n_bad), 1.0 / max(1, len(y) - n_bad))
        # Plain fine sentences weigh like labelled ones of their number at least.
        weight[n_bad : n_bad + len(seeds_fine)] = np.maximum(0.4 / len(seeds_fine), weight[-1])
        if model is not None:  # what is fine but was nearly taken for abusive weighs more
            hard.update(w for w, h in zip(good, model.scores(good) > NEARLY, strict=True) if h)
            weight[n_bad + len(seeds_fine) :][[w in hard for w in good]] *= HARD_WEIGHT
        others = sorted(groups)
        pairs = [(w, i) for w in lists for i, x in enumerate(w) if x in groups]
        left, right = [], []
        for k, (w, i) in enumerate(pairs):
            for j in (1, 7, 13):
                left.append(w)
                right.append([*w[:i], others[(k * 5 + j * 11) % len(others)], *w[i + 1 :]])
        swapped = (_Rows(left, vocabulary), _Rows(right, vocabulary)) if pairs else None
        model = Model(_fit(_Rows(lists, vocabulary), y, weight, swapped), groups)
    return model


def _shape(words: Sequence[str], groups: frozenset[str]) -> list[str]:
    """Runs of five word classes: what sentences of one make share."""
    classed = ["GROUP" if w in groups else _class(w) or w for w in words]
    return [" ".join(classed[i : i + 5]) for i in range(max(1, len(classed) - 4))]


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "abusive") -> Model:
    """Fitted on at most MOST_LABELLED labelled documents; a document with several labels counts by their majority, a tie as abusive.

    Of documents that share a labelled id, the one with the least text counts.
    """
    votes = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    sample = votes.orderBy(F.xxhash64(doc_id), doc_id).limit(MOST_LABELLED)
    rows = docs.select(doc_id, F.col(text).alias("_text")).join(sample, doc_id).groupBy(doc_id).agg(F.min("_text").alias("_text"), F.max("_y").alias("_y")).collect()
    return train(sorted(((r["_text"], r["_y"]) for r in rows), key=lambda x: (x[1], x[0] or "")))


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and score (0 to 1) of every document: the score of its worst sentence; null and empty texts have 0."""
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.groups))  # of fixed size
    source = docs.select(*keep, F.col(text).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    k = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = sent.value
        known: dict[str, float] = {}
        for batch in batches:
            if len(known) > MOST_KNOWN:
                known.clear()
            each = [sentences(t) for t in batch.column(k).to_pylist()]
            new = list(dict.fromkeys(s for ss in each for s in ss if s not in known))
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                known.update(zip(part, worst.scores(word_lists(part)).tolist(), strict=True))
            scores = [max((known[s] for s in ss), default=0.0) for ss in each]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return spread(source).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))

"""Held-out texts that leak into a corpus: embedding of edits, bit sampling, exact check.

Windows of words of the held-out items and of the documents are embedded by random walks (CGK):
a walk copies the word it stands on and moves on or stays by a random bit of step and word, so
that windows a few edits apart agree in most places. Sampled places of several such embeddings
are hashed; equal hashes make a candidate, which must be within two edits and lie in a passage
that passes an exact check by words and edits. One pass over the documents, without a shuffle; the held-out set
is the broadcast side, in blocks of a checked size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Words in a row that count as repeated, and words of a section that may have one edit in EDIT_SHARE.
RUN, SECTION, EDIT_SHARE = 12, 24, 6
WINDOW = 12
#: A window of a section within the limits has at most this many edits somewhere in it (pigeonhole).
WINDOW_EDITS = 2
EMBEDDINGS, TABLES, PLACES = 4, 32, 8
#: Item words per broadcast block, and blocks that one pass over the documents holds: about 60 MB each in a task.
BLOCK_WORDS, PASS_BLOCKS = 100_000, 4
#: Windows embedded at once in a task.
BATCH_WINDOWS = 100_000
#: Characters of documents that a task splits into words at once.
BATCH_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_BITMAP = 22


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last bits of hashes: two filters before the binary search."""
    return (key >> np.uint64(64 - _BITMAP)).astype(np.int64), (key & np.uint64((1 << _BITMAP) - 1)).astype(np.int64)


class Index:
    """Item windows by the hashes of sampled places. Built on the driver from one block of items."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int = 5):
        rng = np.random.default_rng(seed)
        lists = [(i, words_of(t)) for i, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in lists for w in ws}))}
        n = len(self.vocabulary)
        self.other, self.pad = n, n + 1  # a word of no item; the end of a window
        self.ids = [i for i, _ in lists]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in lists]
        # steps x symbols: whether the walk moves on
        self.moves = rng.integers(0, 2, (EMBEDDINGS, 2 * WINDOW, n + 2), dtype=np.int8)
        self.places = [(t % EMBEDDINGS, np.sort(rng.choice(2 * WINDOW - 2, PLACES, replace=False))) for t in range(TABLES)]
        self.factors = rng.integers(1, 2**63, (TABLES, PLACES + 1), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        where, at = [], []
        for k, ws in enumerate(self.words):
            m = len(ws) - WINDOW + 1
            if m > 0:
                where.append(np.full(m, k, np.int32))
                at.append(np.arange(m, dtype=np.int32))
        self.item = np.concatenate(where) if where else np.zeros(0, np.int32)
        self.start = np.concatenate(at) if at else np.zeros(0, np.int32)
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int32)
        first = np.cumsum([0, *map(len, self.words)])[:-1] if self.words else np.zeros(0, np.int64)
        self.flat, self.first, self.size = flat, first, np.array([len(ws) for ws in self.words], np.int64)
        self.at = (first[self.item] + self.start).astype(np.int64) if len(self.item) else np.zeros(0, np.int64)
        self.windows = flat[self.at[:, None] + np.arange(WINDOW)] if len(self.at) else np.zeros((0, WINDOW), np.int32)
        keys, owner = [], []
        for _, key in self.hashes(self.windows):
            keys.append(key)
            owner.append(np.arange(len(key), dtype=np.int32))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        own = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        order = np.argsort(key, kind="stable")
        self.key, self.own = key[order], own[order]
        self.bitmaps = []
        for spot in _bits(self.key):
            self.bitmaps.append(np.zeros(1 << _BITMAP, bool))
            self.bitmaps[-1][spot] = True

    def embed(self, windows: np.ndarray, e: int) -> np.ndarray:
        """places x windows: the symbols that the e-th walk copies."""
        n = len(windows)
        flat = np.ascontiguousarray(np.concatenate([windows, np.full((n, 1), self.pad, np.int32)], axis=1)).ravel()
        base = np.arange(n, dtype=np.int64) * (WINDOW + 1)
        spot = np.zeros(n, np.int64)
        out = np.empty((2 * WINDOW, n), np.int32)
        for step in range(2 * WINDOW):
            symbol = flat[base + spot]
            out[step] = symbol
            spot += self.moves[e, step][symbol]
            np.minimum(spot, WINDOW, out=spot)
        return out

    def hashes(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for e in range(EMBEDDINGS):
            places = self.embed(windows, e).astype(np.uint64)
            for t in range(e, TABLES, EMBEDDINGS):
                key = np.full(len(windows), self.factors[t, PLACES])
                for p, f in zip(self.places[t][1], self.factors[t], strict=False):
                    key ^= key >> np.uint64(29)
                    key *= f
                    key += places[p]
                key ^= key >> np.uint64(32)
                key *= self.factors[t, 0]
                yield t, key

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of windows, item window) of equal hash in some table, each pair once."""
        found = []
        for _, key in self.hashes(windows):
            high, low = _bits(key)
            rows = np.flatnonzero(self.bitmaps[0][high])
            rows = rows[self.bitmaps[1][low[rows]]]
            if not len(rows):
                continue
            lo = np.searchsorted(self.key, key[rows], side="left")
            n = np.searchsorted(self.key, key[rows], side="right") - lo
            rows, lo, n = rows[n > 0], lo[n > 0], n[n > 0]
            if not len(rows):
                continue
            own = self.own[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            found.append(np.repeat(rows, n).astype(np.int64) << 32 | own)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF


def near_windows(doc: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each item window is within WINDOW_EDITS edits of some words about the place in the document."""
    out = np.zeros(len(starts), bool)
    for a in range(0, len(starts), 50_000):
        at = starts[a : a + 50_000, None] + np.arange(-WINDOW_EDITS, WINDOW + WINDOW_EDITS)
        near = np.where((at >= 0) & (at < len(doc)), doc[np.clip(at, 0, len(doc) - 1)], -1)
        row = np.zeros((len(at), near.shape[1] + 1), np.int8)  # edits from nothing to any start in the document
        for i in range(WINDOW):
            above, row = row, np.empty_like(row)
            row[:, 0] = i + 1
            np.minimum(above[:, :-1] + (near != windows[a : a + 50_000, i : i + 1]), above[:, 1:] + 1, out=row[:, 1:])
            for j in range(1, row.shape[1]):
                np.minimum(row[:, j], row[:, j - 1] + 1, out=row[:, j])
        out[a : a + 50_000] = row.min(axis=1) <= WINDOW_EDITS
    return out


#: Edits that a section of less than twice SECTION words may have (a longer one can be halved), and how far it drifts from the diagonal of a window in it.
MOST_EDITS = (2 * SECTION - 1) // EDIT_SHARE
DRIFT = MOST_EDITS + WINDOW_EDITS
#: Diagonals of a band, its margins included, and rows of bands that are checked at once.
BAND, BAND_ROWS = 32 + 2 * DRIFT, 50_000


def bands(pair: np.ndarray, row: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, first row, last row, first diagonal) of the stripes in which sections through these windows lie.

    `row` is where a window starts in its item, `diagonal` how much later it starts in the document.
    """
    block = diagonal // 32
    order = np.lexsort((row, block, pair))
    pair, row, block = pair[order], row[order], block[order]
    reach = 2 * SECTION + WINDOW
    new = np.r_[True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1]) | (row[1:] > row[:-1] + 2 * reach)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(row)] - 1
    return pair[first], row[first] - reach, row[last] + reach, block[first] * 32 - DRIFT


def repeating(items: np.ndarray, item_at: np.ndarray, item_size: np.ndarray, docs: np.ndarray, doc_at: np.ndarray, doc_size: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """For each band, whether within it the document repeats RUN words of the item in a row, or SECTION of them with one edit in EDIT_SHARE words at most.

    Items and documents lie one after the other in `items` and `docs`. Exact: a section of twice
    SECTION words can be halved, so only shorter ones are tried, from every pair of equal words
    that no equal pair precedes, by how far any number of edits reaches. All bands of a call are
    worked on at once.
    """
    low, high = np.maximum(low, 0), np.minimum(high, item_size)
    rows = high - low + 1  # and a row of mismatches after the last
    first = np.cumsum(rows) - rows
    total = int(rows.sum())
    owner = np.repeat(np.arange(len(low)), rows)
    i = np.arange(total) - first[owner] + low[owner]
    j = i[:, None] + diagonal[owner][:, None] + np.arange(BAND)
    inside = (j >= 0) & (j < doc_size[owner][:, None]) & (i < high[owner])[:, None]
    word = items[np.minimum(item_at[owner] + i, len(items) - 1)]
    equal = inside & (docs[np.clip(doc_at[owner][:, None] + j, 0, len(docs) - 1)] == word[:, None])
    here = np.arange(total, dtype=np.int32)[:, None]
    stop = np.minimum.accumulate(np.where(equal, np.int32(total), here)[::-1])[::-1]
    common = stop - here  # words in a row that are equal from here on
    found = np.zeros(len(low), bool)
    found[owner[(common >= RUN).any(axis=1)]] = True
    begins = equal & ~found[owner][:, None] & (item_size[owner] >= SECTION)[:, None]
    begins[1:] &= ~equal[:-1]
    at, d0 = np.nonzero(begins)
    wide = 2 * MOST_EDITS + 1
    # By start and drift from its diagonal: item words used up so far, -1 where no path leads.
    reach = np.full((len(at), wide + 2), -1, np.int32)
    reach[:, MOST_EDITS + 1] = common[at, d0]
    for edits in range(MOST_EDITS + 1):
        longest = reach.max(axis=1)
        size = item_size[owner[at]]
        for spare in range(MOST_EDITS - edits + 1):  # edits at either end of the section lengthen it
            length = longest + np.minimum(spare, size - longest)
            found[owner[at[(length >= SECTION) & (EDIT_SHARE * (edits + spare) <= length)]]] = True
        on = (longest >= EDIT_SHARE * (edits - 2)) & ~found[owner[at]]  # else too many edits so far
        at, d0, reach = at[on], d0[on], reach[on]
        if edits == MOST_EDITS or not len(at):
            break
        wider = np.full_like(reach, -1)
        move = np.where(reach >= 0, reach + 1, -1)
        wider[:, 1:-1] = np.maximum(np.maximum(move[:, 1:-1], move[:, 2:]), reach[:, :-2])  # replaced, left out, added
        drift = d0[:, None] + np.arange(wide) - MOST_EDITS
        spot = at[:, None] + wider[:, 1:-1]
        end = (first + rows - 1)[owner[at]][:, None]
        ok = (wider[:, 1:-1] >= 0) & (spot <= end) & (drift >= 0) & (drift < BAND)
        wider[:, 1:-1] = np.where(ok, wider[:, 1:-1] + common[np.where(ok, spot, 0), np.clip(drift, 0, BAND - 1)], -1)
        reach = wider
    return found


def repeats(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether `doc` repeats a part of `item`, tried on all diagonals: what repeating() finds about windows."""
    if not len(item) or not len(doc):
        return False
    starts = np.arange(-len(item), len(doc), BAND - 2 * DRIFT) - DRIFT
    one = np.ones(len(starts), np.int64)
    return bool(repeating(item, 0 * one, len(item) * one, doc, 0 * one, len(doc) * one, 0 * one, len(item) * one, starts).any())


def leaks_in(index: Index, texts: list[str | None]) -> list[tuple[int, int]]:
    """(number of the text, number of the item) of every leak that the index finds."""
    return leaks_of_words(index, [words_of(t) for t in texts])


def leaks_of_words(index: Index, texts: list[list[str]]) -> list[tuple[int, int]]:
    lists: list[np.ndarray] = []
    get, other = index.vocabulary.get, index.other
    for words in texts:
        lists.append(np.array([get(w, other) for w in words], np.int32))
    out: list[tuple[int, int]] = []
    batch: list[int] = []
    size = 0
    for k in range(len(lists)):
        batch.append(k)
        size += len(lists[k])
        if size >= BATCH_WINDOWS or k == len(lists) - 1:
            out += _leaks(index, lists, batch)
            batch, size = [], 0
    return out


def _leaks(index: Index, lists: list[np.ndarray], batch: list[int]) -> list[tuple[int, int]]:
    lengths = np.array([len(lists[k]) for k in batch], np.int64)
    flat = np.concatenate([lists[k] for k in batch]) if batch else np.zeros(0, np.int32)
    if not len(flat) or not len(index.key):
        return []
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(batch)), lengths)
    pairs, rows_, diagonals = [], [], []
    strange = np.concatenate([[0], np.cumsum(flat == index.other)])
    for a in range(0, len(flat), BATCH_WINDOWS):  # one very long text is cut into several batches of windows
        starts = np.arange(a, min(a + BATCH_WINDOWS, len(flat)))
        starts = starts[(starts - first[owner[starts]]) + WINDOW <= lengths[owner[starts]]]
        # a window with so many words of no item can't be within two edits of an item's window
        starts = starts[strange[starts + WINDOW] - strange[starts] <= 2 * WINDOW_EDITS]
        if not len(starts):
            continue
        rows, own = index.candidates(flat[starts[:, None] + np.arange(WINDOW)])
        good = near_windows(flat, starts[rows], index.windows[own])
        spots, own = starts[rows[good]], own[good]
        pairs.append(owner[spots] << 32 | index.item[own])
        rows_.append(index.start[own].astype(np.int64))
        diagonals.append(spots - first[owner[spots]] - rows_[-1])
    if not sum(map(len, pairs)):
        return []
    pair, low, high, diagonal = bands(np.concatenate(pairs), np.concatenate(rows_), np.concatenate(diagonals))
    doc, item = pair >> 32, pair & 0xFFFFFFFF
    found: set[tuple[int, int]] = set()
    cut = np.cumsum(high - low) // BAND_ROWS
    for part in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(cut)) + 1):
        hit = repeating(index.flat, index.first[item[part]], index.size[item[part]], flat, first[doc[part]], lengths[doc[part]], low[part], high[part], diagonal[part])
        found.update(zip(doc[part][hit].tolist(), item[part][hit].tolist(), strict=True))
    return sorted((batch[d], i) for d, i in found)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, doc_id) of every document that repeats part of an item.

    A document repeats an item if it has RUN consecutive words of it, or SECTION of them with one
    word in six replaced, left out or added at most. Words are runs of letters and digits without
    case. Null and short texts repeat nothing; no items give an empty result; items of one id in
    one block are one item; equal documents have a row each, as have all items of a shared passage.
    Only where an item is longer than BLOCK_WORDS, a document id that is repeated has one row. The
    driver reads the items one by one; PASS_BLOCKS blocks are one pass over the documents. Other
    columns aren't read.
    """
    held = items.select(F.col(item_id), F.col(item_text)).filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    kinds = dict(docs.dtypes) | {"": dict(items.dtypes)[item_id]}
    schema = f"`{item_id}` {kinds['']}, `{doc_id}` {kinds[doc_id]}"
    spark = docs.sparkSession
    source = spread(docs.select(doc_id, text))
    out: DataFrame | None = None
    spans = False  # whether an item lies in several blocks
    blocks = item_blocks(held.toLocalIterator())
    while True:
        taken = list(islice(blocks, PASS_BLOCKS))
        if not taken:
            break
        spans = taken[-1][1]
        sent = [spark.sparkContext.broadcast(Index(block)) for block, _ in taken]

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                sizes = np.cumsum([len(t) if t else 0 for t in texts])
                for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // BATCH_CHARS)) + 1):
                    words = [words_of(texts[k]) for k in part.tolist()]
                    for index in (s.value for s in sent):
                        # parts of one item count once
                        pairs = list(dict.fromkeys((k, index.ids[i]) for k, i in leaks_of_words(index, words)))
                        if pairs:
                            rows, ids = zip(*pairs, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).take(pa.array(part[list(rows)], pa.int64()))], names=[item_id, doc_id])

        part = source.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.distinct() if spans else out


def item_blocks(items: Iterator[tuple], most: int | None = None) -> Iterator[tuple[list[tuple], bool]]:
    """Blocks of (item, text) of at most `most` (BLOCK_WORDS) words, one at a time, and whether an item is cut between blocks so far.

    The parts of a longer item overlap by as much as a section is long.
    """
    most = most or BLOCK_WORDS
    overlap = 2 * SECTION
    block: list[tuple] = []
    room, spans = most, False
    for name, text in items:
        words = words_of(text)
        at = 0
        while True:
            if len(words) - at > room and block:
                yield block, spans
                block, room = [], most
            part = words[at : at + room]
            block.append((name, " ".join(part)))
            room -= len(part)
            if at + len(part) >= len(words):
                break
            at += len(part) - overlap
            spans = True
    if block:
        yield block, spans

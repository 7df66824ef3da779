"""Bottom-k sketches of sets of hashes, and the similarity they estimate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SIZE = 16
#: Hashes whose numbers of classes are known to all tasks, the commonest; the others count as equally rare.
COMMON = 20_000
#: Pairs that are compared at once, by their bits and in full.
BLOCK_PAIRS, EXACT_PAIRS = 1 << 17, 1 << 15
#: What fills up rows of shorter sketches; no hash of 60 bits.
_NONE = np.iinfo(np.int64).max


def sketch_of(hashes: Column, size: int = SIZE) -> Column:
    """The least distinct hashes in rising order; shorter than `size`, it is the whole set."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, size)


def word_sketch(words: Column, size: int = SIZE) -> Column:
    """sketch_of() of the words' portable_hash(): hexadecimal digits of one length sort as their numbers, so only those that stay are converted."""
    digits = F.transform(words, lambda w: F.substring(F.md5(w), 1, 15))
    return F.transform(F.slice(F.sort_array(F.array_distinct(digits)), 1, size), lambda h: F.conv(h, 16, 10).cast("bigint"))


def sketch_rows(rows: DataFrame, keys: list[str], value: Column, size: int = SIZE) -> DataFrame:
    """keys, sketch: distinct values first, so that repeated ones are gone before the lists are collected."""
    distinct = rows.select(*keys, value.alias("_h")).filter("_h is not null").distinct()
    least = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).filter(F.col("_r") <= size)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias("sketch"))


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union; merging is associative and doesn't depend on order."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def similarity(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated Jaccard similarity: exact if both are whole sets; two empty sketches have 0."""
    union = merged(a, b, size)
    both = F.filter(union, lambda x: F.array_contains(a, x) & F.array_contains(b, x))
    return F.when(F.size(union) == 0, 0.0).otherwise(F.size(both) / F.size(union))


def sketch_classes(rows: DataFrame, id_: str, sketch: str) -> DataFrame:
    """`id_`, class_id: rows of equal sketches are one class, named by its least id; null sketches have none."""
    known = rows.filter(F.col(sketch).isNotNull()).select(id_, F.col(sketch).alias("_s"))
    return known.join(known.groupBy("_s").agg(F.min(id_).alias("class_id")), "_s").select(id_, "class_id")


def near_classes(rows: DataFrame, id_: str, sketch: str, least: float, size: int = SIZE) -> DataFrame:
    """left_class, right_class, similarity: all pairs of classes of equal sketches whose estimated similarity is `least` (above 0) or more.

    Lossless: sketches that are so similar share at least ceil(least * length) hashes, hence one of
    the length - ceil(least * length) + 1 rarest of either. Copies are one class, so that a text
    that a third of the rows repeat is one row here; common hashes come last in the order of rarity,
    so they bring candidates together only for sketches that have nothing else. Sketches themselves
    move to each of their rarest hashes, pairs are compared there and only results leave the task:
    candidates may be as many as the square of the rows and are never written. A pair is told by
    the rarest hash that it shares, so it comes up once. A task holds the sketches of one hash.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    # Cut here, as hashes are counted before they are shelved: texts are hashed once.
    classes = cut_lineage(rows.filter(F.size(sketch) > 0).groupBy(F.col(sketch).alias("_s")).agg(F.min(id_).alias("_c")))
    often = classes.select(F.explode("_s").alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_often"))
    common = often.orderBy(F.desc("_often"), "_h").limit(COMMON).collect()
    hashes, counts = (np.array(x, np.int64) for x in zip(*sorted((r["_h"], r["_often"]) for r in common), strict=True)) if common else (np.zeros(0, np.int64),) * 2
    kind = dict(classes.dtypes)["_c"]
    # Of two sketches' union of `size` hashes at most `apart` are in one of them only.
    apart = size - math.ceil(size * least - 1e-9)

    def times(h: np.ndarray) -> np.ndarray:
        """How many classes have each hash, 0 if it isn't common."""
        if not len(hashes):
            return np.zeros(h.shape, np.int64)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, counts[at], 0)

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every sketch at each of its rarest hashes."""
        for batch in batches:
            own, n = _padded(batch.column(1), size)
            known = own != _NONE
            order = np.lexsort((own, np.where(known, times(own), _NONE)), axis=1)
            # A whole sketch may be the beginning of a larger set, so what must be shared is a share of the sketch itself.
            i, k = np.nonzero(np.arange(own.shape[1]) < (n - np.ceil(n * least - 1e-9).astype(int) + 1)[:, None])
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(own[i, order[i, k]], pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], names=["_h", "_c", "_s"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of every hash; its rows follow each other, in the order of their ids."""
        for h, ids, listed in _whole_groups(batches):
            own, _ = _padded(listed, size)
            free = ~_bits(own)
            # What of a sketch is sure to be among the least `size` of a union with a similar one.
            sure = _bits(own[:, : size - apart])
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            lefts, rights, waiting = [], [], 0
            for first, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                step = max(1, BLOCK_PAIRS // (end - first))
                for i in range(first, end - 1, step):
                    rows_ = slice(i, min(i + step, end))
                    p, q = np.divmod(np.flatnonzero(np.bitwise_count(sure[rows_, None] & free[None, i:end]) <= apart), end - i)
                    p, q = p[p < q] + i, q[p < q] + i
                    close = np.bitwise_count(sure[p] & free[q]) + np.bitwise_count(sure[q] & free[p]) <= apart
                    lefts.append(p[close])
                    rights.append(q[close])
                    waiting += len(lefts[-1])
                    if waiting >= EXACT_PAIRS:
                        yield from told(h, ids, own, np.concatenate(lefts), np.concatenate(rights))
                        lefts, rights, waiting = [], [], 0
            if waiting:
                yield from told(h, ids, own, np.concatenate(lefts), np.concatenate(rights))

    def told(h: np.ndarray, ids: pa.Array, own: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(p), EXACT_PAIRS):
            i, j = p[k : k + EXACT_PAIRS], q[k : k + EXACT_PAIRS]
            both = np.sort(np.concatenate([own[i], own[j]], axis=1), axis=1)
            real = both != _NONE
            again = np.zeros(both.shape, bool)
            again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
            rank = np.cumsum(~again & real, axis=1)  # of each hash in the union
            similar = (again & (rank <= size)).sum(axis=1) / np.minimum(rank[:, -1], size)
            often_ = np.where(again, times(both), _NONE)
            rarest = np.where(again & (often_ == often_.min(axis=1)[:, None]), both, _NONE).min(axis=1)
            good = (similar >= least - 1e-12) & (rarest == h[i])
            if good.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[good])), ids.take(pa.array(j[good])), pa.array(similar[good])], names=["left_class", "right_class", "similarity"])

    shelf = classes.select("_c", "_s").mapInArrow(shelved, f"_h bigint, _c {kind}, _s array<bigint>")
    return shelf.repartition("_h").sortWithinPartitions("_h", "_c").mapInArrow(met, f"left_class {kind}, right_class {kind}, similarity double")


def _padded(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of distinct hashes as rising rows of one width, the least `size` of each, and how many each has."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    out = np.full((len(n), max(size, n.max(initial=0))), _NONE)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.sort(out, axis=1)[:, :size], np.minimum(n, size)


def _bits(own: np.ndarray) -> np.ndarray:
    """A bit of 64 for every hash of a row."""
    each = np.where(own == _NONE, np.uint64(0), np.uint64(1) << (own & 63).astype(np.uint64))
    return np.bitwise_or.reduce(each, axis=1)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """The columns of batches that are sorted by the first, cut such that no value of it is in two."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        h = batch.column(0).to_numpy()
        if not len(h):
            continue
        if kept and kept[0].column(0)[0].as_py() != h[0]:
            yield _columns(kept)
            kept = []
        last = int(np.searchsorted(h, h[-1]))
        if last:
            yield _columns([*kept, batch.slice(0, last)])
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield _columns(kept)


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    h, ids, listed = pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=1 << 62)[0].columns
    return h.to_numpy(), ids, listed

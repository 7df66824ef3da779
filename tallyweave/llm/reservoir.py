"""Uniform samples of fixed size from data of unknown length that arrives in pieces.

The state of a reservoir is spread over hash-partitioned slots. What an arriving batch does to it
is drawn from counts alone: a hypergeometric number of replacements, split over the slots, as many
uniform evictions, and the insertion of a sample of the batch. Drawing from counts leaves, for each
batch and slot, how many of its records are in the sample in the end; which ones is decided by a
seeded hash per record, so a task that runs again chooses the same records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a reservoir, and items that a slot of a large one holds: a capacity of more than SLOTS times that has more slots.
SLOTS, SLOT_ITEMS = 16, 100_000


def generator(seed: int, *names: object) -> np.random.Generator:
    """A generator that depends on the seed and the names only, on any machine."""
    digest = hashlib.blake2b(repr((seed, *names)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "big")))


#: numpy's hypergeometric takes populations below this.
NUMPY_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` draws without replacement are among the `good` of good + bad, for any sizes.

    Beyond numpy's bound by inversion from the mode: the ratios of neighbouring probabilities are
    known exactly, so the weights around the mode need no factorials. What lies further out than
    40 deviations has a weight below the rounding of the sum.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    whole = good + bad
    if whole < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, draws))
    mode = min(high, max(low, (good + 1) * (draws + 1) // (whole + 2)))
    deviation = (draws / whole * good / whole * bad * (whole - draws) / max(1, whole - 1)) ** 0.5
    reach = int(40 * deviation) + 60
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = (good - up) * (draws - up) / ((up + 1) * ((bad - draws) + up + 1))
    fall = down * ((bad - draws) + down) / ((good - down + 1) * (draws - down + 1))
    weights = np.r_[np.cumprod(fall)[::-1], 1.0, np.cumprod(rise)]
    upto = np.cumsum(weights)
    return mode - len(down) + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def split_counts(rng: np.random.Generator, have: np.ndarray, wanted: int) -> np.ndarray:
    """How many of `wanted` draws without replacement fall into each cell of `have`."""
    have = np.asarray(have, np.int64)
    out = np.zeros(len(have), np.int64)
    left, total = int(wanted), int(have.sum())
    for i in range(len(have)):
        if not left:
            break
        n = int(have[i])
        rest = total - n
        got = hypergeometric(rng, n, rest, left)
        out[i] = got
        left, total = left - got, rest
    return out


def survivors_per_cell(offered: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """offered[batch, slot]: records of each batch per slot; returns how many of each are in the sample after the last batch."""
    batches, slots = offered.shape
    held = np.zeros((batches, slots), np.int64)
    filled = np.zeros(slots, np.int64)
    used: list[set[int]] = [set() for _ in range(slots)]  # by slot, the batches that hold something: at most `capacity` in all
    seen = 0
    for b in range(batches):
        arrive = offered[b]
        n = int(arrive.sum())
        size = min(capacity, seen + n)
        # Of the new sample, this many come from the batch.
        enter = int(split_counts(rng, np.array([n, seen]), size)[0])
        evict = int(filled.sum()) - (size - enter)
        if evict:
            for s, out in enumerate(split_counts(rng, filled, evict).tolist()):
                if not out:
                    continue
                there = sorted(used[s])
                gone = split_counts(rng, held[there, s], out)
                held[there, s] -= gone
                filled[s] -= out
                used[s] -= {t for t, g in zip(there, gone, strict=True) if g and not held[t, s]}
        if enter:
            held[b] = split_counts(rng, arrive, enter)
            filled += held[b]
            for s in np.flatnonzero(held[b]).tolist():
                used[s].add(b)
        seen += n
    return held


def reservoir_rows(
    df: DataFrame, strata: Sequence[str], item: str, batch: str, capacity: int, seed: int = 7, slots: int | None = None
) -> DataFrame:
    """The sampled rows: `strata`, `item`, `_seen`. Batches arrive in the order of `batch`.

    `slots` is how many tasks share a batch of a stratum; by default as many as hold SLOT_ITEMS
    items each, SLOTS at least. The sample stays distributed, however large `capacity` is.

    Every offered row of a stratum is in its sample with the same probability; a stratum of fewer
    than `capacity` rows is kept whole. A row with a null in `strata` belongs to no stratum. Rows
    that are offered twice count twice. A null `item` or `batch` is an ordinary value (null
    batches come first). An empty table gives an empty sample. Columns may have any other names.
    """
    slots = slots or max(SLOTS, -(-capacity // SLOT_ITEMS))
    rows = df.dropna(subset=list(strata)).select(
        *(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)), F.col(item).alias("_item"), F.col(batch).alias("_batch")
    )
    names = [f"_s{i}" for i in range(len(strata))]
    # A second hash tells rows with one item apart only by chance; equal rows are exchangeable, so their order doesn't matter.
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("_item", "_batch"), F.lit(slots)).cast("int")).withColumn("_mix", F.xxhash64(F.lit(seed), "_item", *names))
    counts = rows.groupBy(*names, "_batch", "_slot").agg(F.count(F.lit(1)).alias("_n"))

    def draw(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        """Works on counts: its rows are batches times slots, not records."""
        ordered = cells.sort_values(["_batch", "_slot"], na_position="first", kind="stable")
        code = (ordered["_batch"].ne(ordered["_batch"].shift()) & ~(ordered["_batch"].isna() & ordered["_batch"].shift().isna())).cumsum().to_numpy() - 1
        code = np.maximum(code - code.min(), 0)
        offered = np.zeros((code.max() + 1, slots), np.int64)
        np.add.at(offered, (code, ordered["_slot"].to_numpy()), ordered["_n"].to_numpy())
        kept = survivors_per_cell(offered, capacity, generator(seed, *key))
        return ordered.assign(_keep=kept[code, ordered["_slot"].to_numpy()], _seen=int(offered.sum()))

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    quota = counts.groupBy(*names).applyInPandas(
        draw, ", ".join(f"{c} {kinds[c]}" for c in [*names, "_batch", "_slot", "_n"]) + ", _keep bigint, _seen bigint"
    )
    cell = Window.partitionBy(*names, "_batch", "_slot").orderBy("_mix", "_item")
    # The constant bound lets Spark drop all but `capacity` rows per cell before the shuffle.
    ranked = rows.withColumn("_rank", F.row_number().over(cell)).filter(F.col("_rank") <= capacity)
    same = [ranked[c].eqNullSafe(quota[c]) for c in [*names, "_batch", "_slot"]]
    joined = ranked.join(quota, same, "inner").filter(F.col("_rank") <= F.col("_keep"))
    return joined.select(*(ranked[f"_s{i}"].alias(c) for i, c in enumerate(strata)), ranked["_item"].alias(item), F.col("_seen"))


def reservoirs(df: DataFrame, strata: Sequence[str], item: str, batch: str, capacity: int, seed: int = 7, slots: int | None = None) -> DataFrame:
    """`strata`, capacity, seen, items (ascending): one row per stratum, of at most `capacity` items each; for capacities that fit a row."""
    rows = reservoir_rows(df, strata, item, batch, capacity, seed, slots)
    return rows.groupBy(*strata).agg(F.lit(capacity).alias("capacity"), F.max("_seen").alias("seen"), F.sort_array(F.collect_list(item)).alias("items"))


def latest_reports(reports: DataFrame, strata: Sequence[str], piece: str) -> DataFrame:
    """One report per stratum and piece: that with the most seen, then the latest, then the one with the largest items."""
    w = Window.partitionBy(*strata, piece).orderBy(F.desc_nulls_last("seen"), F.desc_nulls_last("reported_at"), F.desc_nulls_last("items"))
    return reports.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def merged_reservoirs(reports: DataFrame, strata: Sequence[str], piece: str = "piece", capacity: int | None = None, seed: int = 7) -> DataFrame:
    """`strata`, capacity, seen, items: uniform samples put together from the reservoirs of pieces.

    Each report holds a uniform sample `items` of the `seen` rows offered in its piece. How many
    items each piece gives is hypergeometric in `seen`; which ones is uniform. A repeated report
    of a piece counts once. Reports with a null in `strata`, `seen` or `items` are left out. The
    size of the result is the least capacity that is reported in the stratum, or `capacity`.
    """
    whole = reports.dropna(subset=[*strata, "seen", "items"])
    one = latest_reports(whole, strata, piece)
    sizes = one.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)), F.col(piece).alias("_piece"), "seen", F.size("items").alias("_held"), "capacity")
    names = [f"_s{i}" for i in range(len(strata))]

    def draw(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        ordered = pieces.sort_values("_piece", na_position="first", kind="stable")
        seen = ordered["seen"].to_numpy(np.int64)
        most = capacity or int(ordered["capacity"].dropna().min() if ordered["capacity"].notna().any() else seen.sum())
        # A piece that reports fewer items than it should bounds how large a uniform sample can be.
        short = ordered["_held"].to_numpy(np.int64) < np.minimum(seen, most)
        size = min(most, int(seen.sum()), *(ordered["_held"].to_numpy(np.int64)[short].tolist() or [most]))
        return ordered.assign(_take=split_counts(generator(seed, "merge", *key), seen, size), _total=int(seen.sum()), _size=most)

    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    quota = sizes.groupBy(*names).applyInPandas(
        draw, ", ".join(f"{c} {kinds[c]}" for c in sizes.columns) + ", _take bigint, _total bigint, _size bigint"
    ).select(*names, "_piece", "_take", "_total", "_size")
    same = [one[c].eqNullSafe(quota[n]) for c, n in zip(strata, names, strict=True)] + [one[piece].eqNullSafe(quota["_piece"])]

    def chosen(items: Column, take: Column) -> Column:
        """The `take` items of the least seeded hash: at most `capacity` items lie in the array."""
        keyed = F.transform(items, lambda x, i: F.struct(F.xxhash64(F.lit(seed), x, F.col("_piece")).alias("h"), i.alias("i"), x.alias("x")))
        return F.transform(F.slice(F.array_sort(keyed), 1, take.cast("int")), lambda e: e["x"])

    picked = one.join(quota, same).select(
        *(one[c] for c in strata), F.col("_size").cast("int").alias("capacity"), F.col("_total").alias("seen"), F.when(F.col("_take") > 0, chosen(one["items"], F.col("_take"))).otherwise(F.slice(one["items"], 1, 0)).alias("_chosen")
    )
    return picked.groupBy(*strata).agg(F.max("capacity").alias("capacity"), F.max("seen").alias("seen"), F.sort_array(F.flatten(F.collect_list("_chosen"))).alias("items"))

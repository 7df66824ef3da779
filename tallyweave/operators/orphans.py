"""References to records that do not exist at the time of the reference.

Keys are range-partitioned by their 128-bit hash. Within a range the parents lie as sorted
arrays (key, start of validity, latest end so far); batches of references are looked up in them
by binary search, and only the misses leave the range. There are as many ranges as the rows
need, so only a hot key makes a range large: one with many references is split over several
tasks, one with many parents likewise, and a reference is then a miss only if every part of its
range misses it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage, fresh_name

#: Rows that one task holds of a range, of either side.
PART_ROWS = 400_000

FOREVER = 2**62


def _hashes(keys: Sequence[str]) -> list[Column]:
    cols = [F.col(k) for k in keys]
    return [F.xxhash64(*cols).alias("_h1"), F.xxhash64(F.lit("second"), *cols).alias("_h2")]


def _range_of(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("_h1"), 64 - bits).cast("int") if bits else F.lit(0)


def parent_periods(parents: DataFrame, keys: Sequence[str], start: str, end: str | None) -> DataFrame:
    """(_h1, _h2, _start, _end in microseconds): per key and start, the latest end. Rows with a null key or start are never there."""
    there = parents.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, start)]))
    ends = F.coalesce(F.unix_micros(F.col(end)), F.lit(FOREVER)) if end else F.lit(FOREVER)
    rows = there.select(*_hashes(keys), F.unix_micros(F.col(start)).alias("_start"), ends.cast("bigint").alias("_end"))
    # Of the periods without an end only the earliest matters: a key that is loaded over and over is one row after the partial aggregation.
    open_ = rows.filter(F.col("_end") == FOREVER).groupBy("_h1", "_h2").agg(F.min("_start").alias("_start")).withColumn("_end", F.lit(FOREVER).cast("bigint"))
    if not end:
        return open_
    closed = rows.filter(F.col("_end") < FOREVER).groupBy("_h1", "_h2", "_start").agg(F.max("_end").alias("_end"))
    return open_.unionByName(closed)


def probe(parents: dict[str, np.ndarray], refs: dict[str, np.ndarray]) -> np.ndarray:
    """For each reference, whether a parent of its key is there at its time (binary searches only)."""
    n = len(refs["h1"])
    if not len(parents["h1"]) or not n:
        return np.zeros(n, bool)
    order = np.lexsort((parents["start"], parents["h2"], parents["h1"]))
    h1, h2, start, end = (parents[k][order] for k in ("h1", "h2", "start", "end"))
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    rank = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    k1, k2 = h1[first], h2[first]
    # The running maximum of the ends restarts at each key: ends are shifted into disjoint bands by the key's rank.
    order_of_end = np.unique(end, return_inverse=True)
    bands = rank.astype(np.int64) * (len(order_of_end[0]) + 1) + order_of_end[1]
    latest = order_of_end[0][np.maximum.accumulate(bands) - rank.astype(np.int64) * (len(order_of_end[0]) + 1)]
    at = np.searchsorted(k1, refs["h1"], side="left")
    key = np.full(n, -1, np.int64)
    runs = np.diff(np.r_[np.flatnonzero(np.r_[True, k1[1:] != k1[:-1]]), len(k1)])
    for step in range(int(runs.max())):  # more than one step only where two keys share the first hash
        spot = np.minimum(at + step, len(k1) - 1)
        hit = (at + step < len(k1)) & (k1[spot] == refs["h1"]) & (k2[spot] == refs["h2"])
        key = np.where(hit, spot, key)
    times = np.unique(start)
    own = rank.astype(np.int64) << 32 | np.searchsorted(times, start)
    when = np.searchsorted(times, refs["time"], side="right") - 1
    found = np.flatnonzero((key >= 0) & (when >= 0))
    pos = np.searchsorted(own, key[found] << 32 | when[found], side="right") - 1
    good = (pos >= 0) & (rank[np.maximum(pos, 0)] == key[found])
    pos, found = pos[good], found[good]
    there = np.zeros(n, bool)
    there[found] = latest[pos] > refs["time"][found]
    return there


def orphan_references(
    refs: DataFrame, ref_id: str, at: str, parents: DataFrame, keys: Sequence[str], start: str, end: str | None = None, missing_in: str = "parent"
) -> DataFrame:
    """(ref_id, at, missing_in) of each row of `refs` whose key has no row of `parents` that is there at `at`.

    A parent row is there from `start` (inclusive) until `end` (exclusive; null or no such
    column: for ever). A reference with a null in its key or time refers to nothing and is no
    case. Without any parent, every whole reference is a case. A row of `refs` that is repeated
    is reported as often. Other columns of either table aren't read.
    """
    key_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in (*keys, at)])
    probes = refs.filter(~key_null).select(F.col(ref_id).alias("_id"), F.unix_micros(F.col(at)).alias("_at"), *_hashes(keys))
    periods = parent_periods(parents, keys, start, end)

    most = max(parents.count(), refs.count(), 1)  # of parquet, the footers tell
    bits = min(30, max(0, int(np.ceil(np.log2(most / PART_ROWS)))) + 3)
    side = lambda df, k: df.select(_range_of(bits).alias("_range"), F.lit(1 - k).alias("_l"), F.lit(k).alias("_r"))
    sizes = side(periods, 0).unionAll(side(probes, 1)).groupBy("_range").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    parts = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / PART_ROWS).cast("int")
    hot = cut_lineage(sizes.filter((F.col("_l") > PART_ROWS) | (F.col("_r") > PART_ROWS)).select("_range", parts("_l").alias("_parts0"), parts("_r").alias("_parts1")))
    n_hot = hot.count()
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)

    def dealt(df: DataFrame, side: int, mix: Column) -> DataFrame:
        """One copy of the row for each part of the other side, in one part of its own."""
        df = df.withColumn("_range", _range_of(bits))
        if not n_hot:
            return df.withColumns({"_parts0": F.lit(1), "_part0": F.lit(0), "_part1": F.lit(0)})
        df = df.join(hot, "_range", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_parts0", "_parts1")})
        df = df.withColumn(f"_part{side}", F.pmod(mix, F.col(f"_parts{side}")).cast("int"))
        return df.withColumn(f"_part{1 - side}", F.explode(F.sequence(F.lit(0), F.col(f"_parts{1 - side}") - 1))).drop("_parts1")

    left = dealt(periods, 0, F.xxhash64("_h1", "_h2", "_start"))
    right = dealt(probes, 1, F.xxhash64("_id", "_at"))
    groups = ["_range", "_part0", "_part1"]

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        there = probe(
            {"h1": own["_h1"].to_numpy(np.int64), "h2": own["_h2"].to_numpy(np.int64), "start": own["_start"].to_numpy(np.int64), "end": own["_end"].to_numpy(np.int64)},
            {"h1": asked["_h1"].to_numpy(np.int64), "h2": asked["_h2"].to_numpy(np.int64), "time": asked["_at"].to_numpy(np.int64)},
        )
        return asked.loc[~there, ["_id", "_at", "_h1", "_h2", "_parts0"]]

    id_type = refs.schema[ref_id].dataType.simpleString()
    misses = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(search, f"_id {id_type}, _at bigint, _h1 bigint, _h2 bigint, _parts0 int")
    if n_hot:
        counted = misses.groupBy("_id", "_at", "_h1", "_h2", "_parts0").count()
        misses = counted.withColumn("_n", (F.col("count") / F.col("_parts0")).cast("int")).filter("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    out_at = fresh_name([ref_id, "missing_in"], at)
    return misses.select(F.col("_id").alias(ref_id), F.timestamp_micros("_at").alias(out_at), F.lit(missing_in).alias("missing_in"))


def orphans_per_period(found: DataFrame, at: str, period: str = "month") -> DataFrame:
    """(missing_in, period, orphans) of what orphan_references() found; a period is named by its first day."""
    return found.groupBy("missing_in", F.date_trunc(period, F.col(at)).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("orphans"))

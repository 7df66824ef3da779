"""Exact percentiles of very large columns by bisection, and summaries of shards that add up.

A value interval is kept per group and percentile. Each pass cuts every open interval into
sections, counts the rows below their bounds and narrows to the section that holds the target
rank, down to the least and greatest value in it, until one value is left. A pass is one scan with
a map-side aggregation; what is shuffled is sections, never rows. Rows outside the open intervals
are only compared with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage

#: Sections that a pass cuts an interval into.
SECTIONS = 256
PERMILLES = (250, 500, 750, 900, 990)

_LARGEST = 1.7976931348623157e308


def _rank(n: Column, permille: Column) -> Column:
    """The nearest rank, ceil(n * permille / 1000), at least 1; without floating point."""
    scaled = (n * permille + F.lit(999)).cast("decimal(28,0)")
    return F.greatest(F.lit(1).cast("bigint"), F.floor(scaled / F.lit(1000).cast("decimal(10,0)")).cast("bigint"))


def _section(v: Column, lo: Column, hi: Column, whole: bool, spread: bool) -> Column:
    """The section of v in [lo, hi]: never falling in v, and 0 at lo and the last at hi unless `spread` evens out a long tail."""
    if whole:  # differences of bigints are exact; where they overflow, doubles are fine enough to tell the halves apart
        at = F.coalesce(F.try_subtract(v, lo).cast("double"), v.cast("double") - lo.cast("double"))
        width = F.coalesce(F.try_subtract(hi, lo).cast("double"), hi.cast("double") - lo.cast("double"))
        if spread:
            at, width = F.log1p(at), F.log1p(width)
    else:
        bound = lambda x: F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), x))
        x, low, high = bound(v), bound(lo), bound(hi)
        if spread:
            at, width = F.asinh(x) - F.asinh(low), F.asinh(high) - F.asinh(low)
        else:
            wide = (high - low) > _LARGEST  # beyond the doubles
            at, width = F.when(wide, x / 2 - low / 2).otherwise(x - low), F.when(wide, high / 2 - low / 2).otherwise(high - low)
    # The greatest value is always told from the least, however little the scale tells.
    share = F.when(v == hi, F.lit(1.0)).when(width > 0, at / width).otherwise(F.lit(0.0))
    return F.least(F.lit(SECTIONS - 1), F.floor(share * SECTIONS).cast("int"))


def _closed(lo: Column, hi: Column) -> Column:
    return lo == hi


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, permilles: Sequence[int] = PERMILLES, most_passes: int = 400) -> DataFrame:
    """`groups`, n, permille, value: the value of nearest rank ceil(n * permille / 1000), without error.

    Null and NaN values aren't counted; a null in `groups` is a group of its own; a group without
    values has no row. Ties are one value. `value` may be an integer or a floating column; other
    columns may have any names. Every pass divides an interval by 256 at least on one of two
    scales, so a few passes resolve billions of values.
    """
    kind = dict(df.dtypes)[value]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    v = F.col(value).cast("bigint" if whole else "double")
    names = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), v.alias("_v")).filter(F.col("_v").isNotNull())
    if not whole:
        rows = rows.filter(~F.isnan("_v"))
    asked = F.explode(F.array(*(F.lit(int(p)) for p in permilles)))
    state = (
        rows.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_permille", asked)
        # _rank counts within the interval: the rows below it are taken off as it narrows
        .withColumn("_rank", _rank(F.col("_n"), F.col("_permille")))
    )
    state = cut_lineage(state)
    for step in range(most_passes + 1):
        if step == most_passes:
            raise ValueError(f"not resolved in {most_passes} passes")
        intervals = state.filter(~_closed(F.col("_lo"), F.col("_hi"))).select(*names, "_lo", "_hi").distinct()
        open_ = intervals.count()
        if not open_:
            break
        side = intervals.select(*(F.col(n).alias(f"{n}i") for n in names), "_lo", "_hi")
        if open_ <= BROADCAST_ROWS:
            side = F.broadcast(side)
        on = [F.col(n).eqNullSafe(F.col(f"{n}i")) for n in names] or [F.lit(True)]
        # Before the join each row is cut down to its group and value; the intervals of a group are disjoint or equal.
        inside = rows.join(side, [*on, F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")])
        sections = inside.groupBy(*names, "_lo", "_hi", _section(F.col("_v"), F.col("_lo"), F.col("_hi"), whole, step % 2 == 0).alias("_section")).agg(
            F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        upto = Window.partitionBy(*names, "_lo", "_hi").orderBy("_section")  # at most SECTIONS rows
        below = sections.withColumn("_below", F.sum("_in").over(upto) - F.col("_in"))
        below = below.select(*(F.col(n).alias(f"{n}i") for n in names), F.col("_lo").alias("_loi"), F.col("_hi").alias("_hii"), "_in", "_least", "_most", "_below")
        if open_ * SECTIONS <= BROADCAST_ROWS:
            below = F.broadcast(below)
        same = [F.col(n).eqNullSafe(F.col(f"{n}i")) for n in names] + [F.col("_lo") == F.col("_loi"), F.col("_hi") == F.col("_hii")]
        within = [F.col("_rank") > F.col("_below"), F.col("_rank") <= F.col("_below") + F.col("_in")]
        narrowed = state.join(below, [*same, *within], "left")
        state = cut_lineage(
            narrowed.select(
                *names,
                "_n",
                F.coalesce("_least", "_lo").alias("_lo"),
                F.coalesce("_most", "_hi").alias("_hi"),
                "_permille",
                (F.col("_rank") - F.coalesce("_below", F.lit(0))).alias("_rank"),
            )
        )
    return state.select(*(F.col(n).alias(g) for n, g in zip(names, groups, strict=True)), F.col("_n").alias("n"), F.col("_permille").alias("permille"), F.col("_lo").alias("value"))


# --- summaries that can be combined ---------------------------------------------------------


def shard_counts(df: DataFrame, groups: Sequence[str], value: str, error: float = 0.01) -> DataFrame:
    """`groups`, step, rows: how many values lie in each step of one fixed scale.

    The bounds of the steps depend on `error` alone, so the counts of separate shards or days add
    up. Step 0 holds zero; step k > 0 the values in (g^(k-1), g^k] times the unit, negative steps
    the negative values, where g = (1 + error) / (1 - error). Nulls and NaN aren't counted.
    """
    growth = (1 + error) / (1 - error)
    v = F.col(value).cast("double")
    size = F.floor(F.log(F.least(F.abs(v), F.lit(_LARGEST))) / F.log(F.lit(growth))).cast("int")
    # Steps are shifted such that the smallest positive double has a positive one.
    shift = int(750 / (growth - 1)) + 1
    step = F.when(v == 0, 0).when(v > 0, size + shift).otherwise(-(size + shift))
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, step.alias("step")).agg(F.count(F.lit(1)).alias("rows"))


def combined_percentiles(counts: DataFrame, groups: Sequence[str], permilles: Sequence[int] = PERMILLES, error: float = 0.01) -> DataFrame:
    """`groups`, n, permille, value, low, high from the summed counts of any number of shards.

    The value of nearest rank lies in [low, high]; `value` is off by at most the share `error`
    of it (0.01: one per cent). What of `counts` isn't in `groups` is summed over.
    """
    growth = (1 + error) / (1 - error)
    shift = int(750 / (growth - 1)) + 1
    total = counts.groupBy(*groups, "step").agg(F.sum("rows").alias("_in"))  # as many rows as steps in use
    by = Window.partitionBy(*groups)
    cells = (
        total.withColumn("_n", F.sum("_in").over(by))
        .withColumn("_upto", F.sum("_in").over(by.orderBy("step")))
        .withColumn("permille", F.explode(F.array(*(F.lit(int(p)) for p in permilles))))
        .withColumn("_rank", _rank(F.col("_n"), F.col("permille")))
        .filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_in")))
    )
    power = (F.abs("step") - shift).cast("double")
    near, far = F.pow(F.lit(growth), power), F.pow(F.lit(growth), power + 1)
    middle = 2 * near * far / (near + far)
    sign = F.signum(F.col("step").cast("double"))
    zero = F.col("step") == 0
    return cells.select(
        *groups,
        F.col("_n").alias("n"),
        "permille",
        F.when(zero, 0.0).otherwise(sign * middle).alias("value"),
        F.when(zero, 0.0).when(sign > 0, near).otherwise(-far).alias("low"),
        F.when(zero, 0.0).when(sign > 0, far).otherwise(-near).alias("high"),
    )

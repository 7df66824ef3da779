"""Each row and the one before it of its group, without a group in one task and without texts in a window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread


def previous_ids(rows: DataFrame, groups: Sequence[str], order: Sequence[str], id_: str) -> DataFrame:
    """`id_`, previous_id: every row that has one before it in its group, by `order` (nulls first); null is a group like any other.

    Ids and keys alone are sorted, in ranges of the whole order, so that a group of a third of all
    rows is as many ranges as it needs; the last row of each range is handed to the next one.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    keys = rows.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.col(id_).alias("_id"))
    sort = [*names, *(f"_o{i}" for i in range(len(order))), "_id"]
    # Cut here, as the bounds of the ranges are sampled: they may not be drawn twice.
    ranged = cut_lineage(keys.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()).select("_part", *sort))
    here = F.struct(*names, "_id")
    within = Window.partitionBy("_part").orderBy(*sort)
    lasts = ranged.groupBy("_part").agg(F.max_by(here, F.struct(*sort)).alias("_last"))
    # One row per range that isn't empty.
    handed = lasts.select(F.col("_part").alias("_p"), F.lag("_last").over(Window.orderBy("_part")).alias("_handed"))
    found = ranged.withColumn("_before", F.lag(here).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    first = found.filter("_first").join(F.broadcast(handed), F.col("_part") == F.col("_p")).withColumn("_before", F.col("_handed")).select(*names, "_id", "_before")
    rest = found.filter("not _first").select(*names, "_id", "_before")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_before.{n}")) for n in names], F.col("_before").isNotNull())
    return rest.unionByName(first).filter(same).select(F.col("_id").alias(id_), F.col("_before._id").alias("previous_id"))


def with_previous(rows: DataFrame, groups: Sequence[str], order: Sequence[str], id_: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """pair_id, `keep`, before, after: `text` of every row and of the one before it; texts are moved by id alone. `id_` is unique."""
    pairs = previous_ids(rows, groups, order, id_)
    texts = rows.select(F.col(id_), F.col(text).alias("_t"))
    older = pairs.join(texts.withColumnRenamed(id_, "previous_id"), "previous_id").select(F.col(id_), F.col("_t").alias("before"))
    out = older.join(rows.select(id_, *keep, F.col(text).alias("after")), id_).select(F.col(id_).alias("pair_id"), *keep, "before", "after")
    return spread(out, rows.select(id_, *keep, text))

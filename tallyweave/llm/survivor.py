"""Best representative of each group of rows that mean the same pair.

Written keys are made comparable with built-in expressions, shortened hashes are resolved among
the distinct keys only. The best row of a written key is kept by an aggregation that is partial
before the shuffle, so that a key with a third of all rows costs one row per task; the spellings
of one pair, at most 40, are then ranked by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_HASH = 40
#: Shorter abbreviations than this name no commit.
LEAST_HASH = 4
MEASURES = ["elapsed_ms", "ast_nodes_before", "ast_nodes_after", "peak_memory_bytes"]


def clean_repository(repository: Column) -> Column:
    """Lower case, without outer space, slashes, `./` and `.git`, whatever their order and number."""
    low = F.lower(F.regexp_replace(repository, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.regexp_replace(F.regexp_replace(low, r"^(?:\./|[/\s])+", ""), r"(?:\.git|[/\s])+$", "")


def clean_path(path: Column) -> Column:
    """One way to write a path: forward slashes, no empty, `.` or `x/..` part; letter case stays."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), F.lit("..")) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(path.isNull(), None).when(F.instr(path, "..") > 0, F.array_join(folded, "/")).otherwise(F.array_join(parts, "/"))


def trust(status: Column) -> Column:
    """1 for a row that ran to a known end, 0 for one that was killed or has no status."""
    return F.when(status.isNull() | (status == "killed"), 0).otherwise(1)


def _best_order() -> list[Column]:
    return [F.desc("_trust"), F.desc("_whole"), F.desc_nulls_last("_when"), F.desc("_run")]


def resolved_pairs(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per pair: _repository, _commit, _path, _rows, _first, and `keep` of its best row.

    A pair is a clean repository, commit and path. A hash shorter than 40 digits stands for the
    full one that it begins in the same repository and path; where none or several begin so, it
    stands for itself. Rows with a null commit, repository or path belong to no pair. Best is the
    most trusted, then most complete, then latest (null last), then largest `run_id`.
    """
    keep = keep or ["run_id"]
    hash_ = F.lower(F.trim("commit"))
    rows = df.filter(F.col("commit").isNotNull() & F.col("repository").isNotNull() & F.col("path").isNotNull()).select(
        clean_repository(F.col("repository")).alias("_repository"),
        hash_.alias("_written"),
        clean_path(F.col("path")).alias("_path"),
        trust(F.col("status")).alias("_trust"),
        sum((F.col(c).isNotNull().cast("int") for c in MEASURES), F.lit(0)).alias("_whole"),
        F.col("measured_at").alias("_when"),
        F.col("run_id").alias("_run"),
        F.struct(*keep).alias("_kept"),
    )
    key = ["_repository", "_written", "_path"]
    # One aggregation, partial before the shuffle: a written key is one row per task.
    order = ["_trust", "_whole", "_when", "_run"]
    best = F.max_by(F.struct(*order, "_kept"), F.struct(*order))  # a null time is the least
    one = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.min("_run").alias("_first"), best.alias("_top")).select(*key, "_rows", "_first", "_top.*")

    # From here on there is one row per written key. Sorted downwards, a full hash comes before what it may be shortened to.
    head = F.substring("_written", 1, LEAST_HASH)
    down = Window.partitionBy("_repository", "_path", "_head").orderBy(F.desc("_written"))
    full = F.when(F.length("_written") == FULL_HASH, F.col("_written"))
    here = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        one.withColumn("_head", head)
        .withColumn("_full", full)
        .withColumn("_two", F.when(F.col("_full").isNotNull(), F.struct(F.col("_full").alias("a"), F.last("_full", ignorenulls=True).over(before).alias("b"))))
        .withColumn("_two", F.last("_two", ignorenulls=True).over(here))
    )
    short = (F.length("_written") < FULL_HASH) & (F.length("_written") >= LEAST_HASH)
    begins = F.coalesce(F.startswith(F.col("_two.a"), F.col("_written")), F.lit(False))
    several = F.coalesce(F.startswith(F.col("_two.b"), F.col("_written")), F.lit(False))
    named = seen.withColumn("_commit", F.when(short & begins & ~several, F.col("_two.a")).otherwise(F.col("_written")))
    # A pair is spelled with at most 40 lengths of one hash, so this window is small whatever the data.
    pair = Window.partitionBy("_repository", "_commit", "_path")
    return (
        named.withColumn("_rank", F.row_number().over(pair.orderBy(*_best_order())))
        .withColumn("_rows", F.sum("_rows").over(pair))
        .withColumn("_first", F.min("_first").over(pair))
        .filter("_rank = 1")
        .select("_repository", "_commit", "_path", "_rows", "_first", *(F.col(f"_kept.{c}").alias(c) for c in keep))
    )


def best_of_repeated(df: DataFrame) -> DataFrame:
    """(first_run_id, best_run_id) of each pair that `df` holds more than once."""
    return resolved_pairs(df).filter("_rows > 1").select(F.col("_first").alias("first_run_id"), F.col("run_id").alias("best_run_id"))


def survivors(df: DataFrame) -> DataFrame:
    """The best row of every pair, with clean repository, full commit and path, and how many rows it stands for."""
    keep = [c for c in df.columns if c not in ("repository", "commit", "path", "n_rows")]
    return resolved_pairs(df, keep).select(
        F.col("_repository").alias("repository"), F.col("_commit").alias("commit"), F.col("_path").alias("path"), *keep, F.col("_rows").alias("n_rows")
    )

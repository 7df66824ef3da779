"""Streams of changes: running counts, and the latest generation of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 32) -> DataFrame:
    """A stream of the parquet files that arrive in `folder`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def census_stream(changes: DataFrame, time: str, key: Column, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """window_start, key, changes: counts per window of event time; what comes later than `late` is left to a batch run."""
    windowed = changes.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("changes"))
    return windowed.select(F.col("w.start").alias("window_start"), "key", "changes")


def once(changes: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Each key once, as long as its repetitions come within `late`; the state is bounded by the watermark."""
    return changes.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


POINTER = "latest"


def _pointed(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """The batch and the folder that the pointer file of `path` names, or None before the first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/{POINTER}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return int(name[1:]), f"{path}/{name}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Moves the pointer: a new file is written and renamed over the old one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, new = hadoop.Path(f"{path}/{POINTER}"), hadoop.Path(f"{path}/{POINTER}.new")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    stream.write(name.encode())
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(new, at, options)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that keep_latest() last completed at `path`."""
    found = _pointed(spark, path)
    if found is None:
        raise ValueError(f"no finished batch at {path}")
    return spark.read.parquet(found[1])


def keep_latest(results: DataFrame, path: str, keys: list[str], generation: str):
    """A writer that keeps for every key the row of the highest generation; a result of an older one that comes late is dropped.

    Each batch writes a new version folder from the version that the pointer file names, and the
    pointer moves last: a batch that runs again replaces its own version and leaves the same table,
    and one that the pointer has already passed does nothing. A pointer to a folder that isn't there
    is an error, never an empty history. Rows of one key and generation are exchangeable.
    """
    from ..operators.reports import last_wins

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _pointed(spark, path)
        if held and held[0] >= batch_id:
            return
        whole = batch.unionByName(spark.read.parquet(held[1])) if held else batch
        last_wins(whole, keys, [F.desc(generation)]).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        _point(spark, path, f"v{batch_id}")

    return results.writeStream.foreachBatch(merge)

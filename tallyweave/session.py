"""Session, tables and lineage: the few places that touch Spark's configuration."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Upper bound of what any operator broadcasts by hand, in rows of small fixed width.
BROADCAST_ROWS = 200_000


def build_session(app: str = "tallyweave", cpus: int | str = "*") -> SparkSession:
    """A local session with the settings that the operators expect of a cluster."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` from a checkpoint in the shared folder of `spark.checkpoint.dir`.

    A lost executor costs a re-read, not a re-run. Only where neither the context nor the setting
    names a folder and everything runs in one process on one machine (tests) a temporary one is set;
    on a cluster a missing setting is an error, as executors don't see each other's folders.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallyweave-checkpoint-"))
    return df.checkpoint(eager=eager)


#: The setting for bytes of input per core below which rows are spread over all cores before heavy work, and its default; 0 never spreads.
SPREAD_SETTING, SPREAD_BYTES = "spark.tallyweave.spreadBytes", 32 << 20


def spread(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """`df` over all cores, if its input is too small to be split into as many parts by itself.

    The rows are the same either way. From SPREAD_SETTING bytes a core on the splits of the files
    are parts enough, and nothing is shuffled. The size is the optimizer's estimate for `source`
    (default: `df`; the estimate of a join is of little use); no job runs for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark.conf.get(SPREAD_SETTING, str(SPREAD_BYTES)))
    size = int(str((source or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * least else df


def fresh_name(taken: list[str], wanted: str) -> str:
    """`wanted`, or with underscores put before it, such that no column of `taken` has the name."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.001")

"""Session defaults and the shared work folder of multi-step jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyrook")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or the session's checkpoint folder, or, in a local session
    (tests), a temporary one. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyrook.work.dir", None)
    if not root:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            root = named.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            root = "file://" + tempfile.mkdtemp(prefix="spark-tallyrook-", dir="/tmp")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("tallyrook.work.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str, row_group: int | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet to the work folder and read it back; returns it with its path.

    Cuts the lineage with a table that every executor can read, so a lost executor costs a re-read, not a re-run.
    row_group: about so many bytes in one, for rows of large arrays. A writer holds a row group, and looks at its size
    every 100 rows else; a reader decodes up to 4096 rows of one at once.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    sized = {} if row_group is None else {"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1}
    df.write.options(compression="zstd", **sized).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame, *keys: str, narrow: bool = False) -> DataFrame:
    """df over as many partitions as there are cores, if a small or one-block file gives fewer; dealt by hash of the keys.

    What is narrow behind it would else run in one task. An input of as many partitions as cores stays as it is, unless
    its rows are narrow and cheap to deal: how many of its partitions have rows depends on the files' row groups, and one of
    a million rows is one task, however many partitions its bytes give.
    """
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, n), *keys) if narrow or n < cores else df


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

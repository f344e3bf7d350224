"""SparkSession construction and shared execution settings.

On a cluster the session is created by the deployment (``spark-submit``); the
operators never set a master and never override settings that are already
present. ``get_spark`` exists for tests, the bench and local use.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. AQE coalesces the small post-aggregation
# partitions and splits skewed join partitions at run time.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", driver_memory: str | None = None) -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder that the deployment names in
    ``spark.checkpoint.dir``, or None: the library never picks one."""
    return spark.sparkContext.getCheckpointDir()


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """``spark`` with a checkpoint folder: the one the deployment names or, only
    where none is named (local use, tests), one in the warehouse. For iterative
    fits, whose lineage otherwise grows with every step."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return spark


def work_folder(spark: SparkSession) -> str:
    """Where tables and models that one job hands to another are written: the
    shared checkpoint folder, or the warehouse. Every executor sees both."""
    return checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the shared folder if there is one (a
    lost executor then never sends Spark back to the source), else cached."""
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def let_go(spark: SparkSession) -> None:
    """Removes the shuffle files, caches and broadcasts that nothing refers to any
    more. Spark does so after a collection of the driver's heap, which a driver
    that only schedules fits may not see for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def saved_model(spark: SparkSession, model) -> Iterator:
    """The model as read back from the shared folder, free of the caches and shuffle
    files of its fit; its files go at the end."""
    path = f"{work_folder(spark)}/model_{uuid.uuid4().hex}"
    kind = type(model)
    model.write().save(path)
    del model
    try:
        yield kind.load(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of an answer that is kept as literals, at most; a grid or a report has far fewer.
SMALL_ROWS = 100_000


def small_answer(df: DataFrame) -> DataFrame:
    """An answer of a few rows by construction (a grid, a report), computed now
    and kept as literal rows, free of the models and caches behind it."""
    from quarry.operators.inspect import collect_small
    return df.sparkSession.createDataFrame(collect_small(df, SMALL_ROWS), df.schema)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")

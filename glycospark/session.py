"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on; all can be set at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a join on the patient must not leave the data hashed by patient for what follows, and a
    # patient with much of the table is split even if that costs another shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the state of streams lies on disk, and timers and lists in it need this store
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings (naive timestamps are read as UTC)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own.

    ``shared`` is its shared folder, which can't be set later.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glycospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``.  A session on one machine that names none uses
    its warehouse folder; a cluster that names none is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a result to a new shared folder and read it back: a cut of the lineage that outlives executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame) -> DataFrame:
    """Keep a result that the rest of a plan reads more than once.

    The blocks spill to disk, and Spark recomputes those of a lost executor.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)

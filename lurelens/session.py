"""Session settings the jobs expect. A cluster's own settings win over these."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(app: str = "lurelens", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("LURELENS_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names. Only a local session may go without it: elsewhere every
    executor would write to a disk of its own."""
    shared = checkpoint_dir(spark)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="lurelens-")
    return f"{shared.rstrip('/')}/lurelens-{uuid.uuid4()}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A written table in the shared folder: later steps read it instead of repeating the work, and
    a lost executor costs nothing."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

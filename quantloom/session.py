"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and a state store for stateful streams. On a cluster leave master and shuffle_partitions out: AQE coalesces small partitions.

    checkpoint_dir: a folder that the driver and all executors share, for what is written between jobs (else spark.checkpoint.dir as
    the cluster sets it).
    """
    b = SparkSession.builder.appName("quantloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()

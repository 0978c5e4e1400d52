"""Tables that live for a job: written to the folder that driver and executors share, gone when the application ends."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. Only a session that runs in one machine gets a folder of its own where none is set."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared checkpoint folder, lineage cut: smaller than a checkpoint, and readers take only the columns they need.

    The table goes when the application ends, or with `dropped`.
    """
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """Like `written`, in n buckets by key, so that tables of as many buckets join on it without an exchange.

    Buckets need a name in the catalog, which goes at once: what reads the files knows their buckets by then, and an external table's files stay.
    """
    path = scratch_path(df.sparkSession)
    name = "scratch_" + path.rpartition("/")[2]
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    out = df.sparkSession.table(name)
    out._jdf.queryExecution().analyzed()
    df.sparkSession.sql(f"DROP TABLE {name}")
    return out


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes what tables read of those that `written` or `bucketed` have made, and nothing else; nobody may read them any more."""
    for df in tables:
        spark = df.sparkSession
        path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        home = path(shared_folder(spark))
        home = home.getFileSystem(conf).makeQualified(home)
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = path(folder)
            fs = at.getFileSystem(conf)
            if fs.makeQualified(at).getParent() == home and re.fullmatch("[0-9a-f]{32}", at.getName()):
                if spark.catalog.tableExists(f"scratch_{at.getName()}"):
                    spark.sql(f"DROP TABLE scratch_{at.getName()}")
                fs.delete(at, True)

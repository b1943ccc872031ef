"""Tables in the folder that driver and executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; on a cluster it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    atexit.register(drop)
    return path


def forget(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing will read it again: its consumers have been written themselves."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(shared_dir(spark)) or f"{shared_dir(spark)}/" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str = "level", hashes: bool = False) -> DataFrame:
    """Write to the shared folder and read again, so that a lost executor costs no recomputation. A table of hashes is written without dictionaries, which don't help it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A table for broadcasting if it has at most ``most`` rows, else as it is. For tables that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

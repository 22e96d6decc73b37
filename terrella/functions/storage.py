"""Tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"{application}-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir.

    Only a session whose master is local may leave the setting out: its single process is then given a folder of its own.
    On a cluster, where such a folder would be a different one on each machine, a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder; the number of its rows, counted as they are written, is known to rows()."""
    path = shared_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path, out._settled_rows = path, seen.get.get("rows")
    return out


def rows(df: DataFrame) -> int:
    """The number of rows; of a settled table, without a job."""
    known = getattr(df, "_settled_rows", None)
    return df.count() if known is None else known


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_settled_path", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)

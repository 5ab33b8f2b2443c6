"""Tables written to the shared folder of the cluster to cut lineage.

``spark.checkpoint.dir`` names the folder; it is read from the session and
only set to a folder of our own where it is unset, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='recolith-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recolith/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result no longer depends on the lineage of ``df``: a lost executor
    costs only the tasks that read the table, and what was not deterministic
    (a range partitioning's bounds, a partition id) stays as it was written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

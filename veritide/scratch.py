"""Intermediate tables in the folder that driver and executors share.

Lineage is cut with written Parquet tables, so a lost executor costs one task and
not the steps before it. The folder is the one named in ``spark.checkpoint.dir``, with
a folder in it for each application; one of our own is made only where none is set and
Spark runs in this one process, as in tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local temporary one only if none is named and there is no cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="veritide-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veritide/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """As ``written``, and the number of rows, which is counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), tag)
    return out, seen.get["n"]


def remove_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it once results are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

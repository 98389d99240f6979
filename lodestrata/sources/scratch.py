"""Tables that a query writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which goes when the application ends;
    a temporary one only if that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="lodestrata-tables-"))
            atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
        root = "file://" + _own_root[0]
    folder = f"{root.rstrip('/')}/lodestrata-tables-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(path):
        fs.deleteOnExit(path)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, path: str | None = None, *by: str) -> DataFrame:
    """``df`` written once, in directories by the columns ``by``, and read back: its lineage ends there."""
    path = path or new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

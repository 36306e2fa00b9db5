"""Working tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only where it is unset and all runs in one process."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set(_KEY, found)
    return _qualified(spark, found)


@cache
def _qualified(spark: SparkSession, path: str) -> str:
    """The folder with its file system: one without a scheme is in the cluster's default one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path for a working table, below a folder of this application's own."""
    return f"{shared_dir(spark)}/gridspark/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and keeps later plans small."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_working_tables(spark: SparkSession) -> None:
    """Deletes all that this application wrote with :func:`new_path`; results that still read from it are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridspark/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

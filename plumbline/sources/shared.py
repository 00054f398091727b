"""Tables in the folder that the cluster names in spark.checkpoint.dir: where a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The named folder; a temporary one only where a single local JVM runs everything."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of its own: computed once, read by whoever comes, there after an executor is lost."""
    path = f"{folder(df.sparkSession)}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting lineage with a table in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="firstlook-")
    return _local_folders[context.applicationId]


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet, so that later passes neither recompute nor read spare columns.

    The files stay until the owner of the folder removes them, like Spark's own checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/firstlook-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

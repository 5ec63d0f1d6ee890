"""Training results kept per dataset and target."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


class Results:
    """One Parquet folder per (dataset, target) below a shared root; a new result replaces the old one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, dataset_id: str | None = None, target: str | None = None) -> str:
        path = self.root
        for part, value in (("dataset", dataset_id), ("target", target)):
            path += f"/{part}={quote(value, safe='') if value is not None else '*'}"
        return path

    def put(self, dataset_id: str, target: str, results: DataFrame) -> None:
        results.write.mode("overwrite").parquet(self._path(dataset_id, target))

    def get(self, dataset_id: str, target: str) -> DataFrame | None:
        """The kept result with its dataset and target, or None."""
        try:
            found = self.spark.read.parquet(self._path(dataset_id, target))
        except AnalysisException:
            return None
        return found.select(F.lit(dataset_id).alias("dataset_id"), F.lit(target).alias("target"), "*")

    def clear(self, dataset_id: str | None = None, target: str | None = None) -> None:
        """Forget the results of a dataset, of a target, of one pair, or all."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self._path(dataset_id, target))
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        for match in files.globStatus(path) or []:
            files.delete(match.getPath(), True)

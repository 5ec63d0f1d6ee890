"""Cleaned tables kept under an id, and report tables."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

ID_PATTERN = r"[0-9A-Za-z_-]+"


class UnknownDataset(KeyError):
    """No dataset is kept under this id."""


class Datasets:
    """Parquet tables below one shared folder, one per dataset id."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, dataset_id: str) -> str:
        if not re.fullmatch(ID_PATTERN, dataset_id):
            raise UnknownDataset(f"unknown dataset '{dataset_id}'")
        return f"{self.root}/{dataset_id}"

    def create(self, df: DataFrame, source: str = "") -> str:
        """Keep a table and return its new id. ``source`` is remembered as the name it came from."""
        dataset_id = uuid.uuid4().hex
        df.write.parquet(f"{self._path(dataset_id)}/table")
        self.spark.createDataFrame([(dataset_id, source)], "dataset_id string, source string").coalesce(1).write.json(
            f"{self._path(dataset_id)}/about"
        )
        return dataset_id

    def get(self, dataset_id: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self._path(dataset_id)}/table")
        except AnalysisException as missing:
            raise UnknownDataset(f"unknown dataset '{dataset_id}'") from missing

    def source(self, dataset_id: str) -> str:
        self.get(dataset_id)
        return self.spark.read.schema("source string").json(f"{self._path(dataset_id)}/about").first()["source"]


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a report table as JSON lines, missing values included."""
    report.write.mode(mode).option("ignoreNullFields", False).json(path)

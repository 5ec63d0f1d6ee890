"""Feature vectors: median and mode filled, standardized, one-hot encoded, fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_label, as_number, data_type, q
from ..operators.clean import medians, modes


@dataclass(frozen=True)
class FittedFeatures:
    """Everything learned from the training rows; applies to any rows with the same columns."""

    numeric: list[str]
    categorical: list[str]
    median: dict[str, float | None]
    mean: dict[str, float]
    deviation: dict[str, float]
    mode: dict[str, str | None]
    encoder: PipelineModel

    def _scaled(self, df: DataFrame, name: str) -> Column:
        value = F.coalesce(as_number(q(name), data_type(df, name)), F.lit(self.median[name]), F.lit(0.0))
        return (value - F.lit(self.mean[name])) / F.lit(self.deviation[name])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``. A category unknown to the training rows becomes all zeros."""
        return self.encoder.transform(df.select("*", *_columns(self, df))).drop(
            *[f"_n{i}" for i in range(len(self.numeric))],
            *[f"_{kind}{i}" for kind in "cih" for i in range(len(self.categorical))],
        )


def _columns(fitted: FittedFeatures, df: DataFrame) -> list[Column]:
    filled = [
        F.coalesce(as_label(q(n), data_type(df, n)), F.lit(fitted.mode[n])).alias(f"_c{i}")
        for i, n in enumerate(fitted.categorical)
    ]
    return [fitted._scaled(df, n).alias(f"_n{i}") for i, n in enumerate(fitted.numeric)] + filled


def fit_features(train: DataFrame, numeric: list[str], categorical: list[str]) -> FittedFeatures:
    """Learn fill values, scales and category lists. Category lists are as short as the row cap allows."""
    median = medians(train, numeric)
    mode = modes(train, categorical)
    filled = [
        F.coalesce(as_number(q(n), data_type(train, n)), F.lit(median[n]), F.lit(0.0)) for n in numeric
    ]
    moments = train.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)],
    ).first()
    stages: list = []
    inputs = [f"_n{i}" for i in range(len(numeric))]
    if categorical:
        raw, index, hot = ([f"_{kind}{i}" for i in range(len(categorical))] for kind in "cih")
        stages += [
            StringIndexer(inputCols=raw, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    fitted = FittedFeatures(
        numeric, categorical, median,
        {n: moments[f"m{i}"] for i, n in enumerate(numeric)},
        {n: moments[f"s{i}"] or 1.0 for i, n in enumerate(numeric)},
        mode, PipelineModel([]),
    )
    encoder = Pipeline(stages=stages).fit(train.select(*_columns(fitted, train)))
    return replace(fitted, encoder=encoder)

"""Features from columns of any type."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler


def feature_pipeline(categorical: list[str] = (), numeric: list[str] = (), output: str = "features", one_hot: bool = True) -> Pipeline:
    """An unfitted pipeline: text columns become `<column>_index` (the most frequent value 0, ties by value; values unseen
    in fitting, and null, share the next number), one-hot if asked for, and all columns one vector."""
    indexed = [f"{c}_index" for c in categorical]
    stages = [StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep")] if categorical else []
    parts = indexed
    if categorical and one_hot:
        parts = [f"{c}_flags" for c in categorical]
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=parts))
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*parts, *numeric], outputCol=output, handleInvalid="keep")])

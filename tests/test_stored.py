"""Learners store what their fits read, as plain columns."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from deltaplane.operators import learners as le
from deltaplane.operators.roles import Experiment
from deltaplane.sources.simulate import randomised_trial


@pytest.mark.parametrize("kind", [le.TLearner, le.XLearner, le.RLearner])
def test_no_vectors_and_no_other_columns(spark, monkeypatch, kind):
    df = randomised_trial(spark, 200, 5, seed=3).withColumn("other", F.lit("text")).withColumn("w", F.lit(2.0))
    seen: list[DataFrame] = []
    real = Classic.persist
    monkeypatch.setattr(Classic, "persist", lambda self, *a: (seen.append(self), real(self, *a))[1])
    e = Experiment(key=("unit",), features=("feature_1", "feature_2"))
    weighted = le.Base(LinearRegression, {"weightCol": "w"}) if kind is le.TLearner else le.Base(LinearRegression)
    out = kind(weighted, e).fit(df).predict(df)
    assert out.columns == [*df.columns, "score"] and out.where("score is null").isEmpty()
    assert set(seen[0].columns) <= {"feature_1", "feature_2", "outcome", "__t", "__fold", "w"}
    assert "vector" not in {t for _, t in seen[0].dtypes}

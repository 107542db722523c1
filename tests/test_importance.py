"""Permutation importance where a feature is also part of the key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deltaplane.operators.forest import UpliftForest, permutation_importance
from deltaplane.operators.roles import Experiment
from deltaplane.sources.simulate import randomised_trial


def test_a_key_as_a_feature(spark):
    """The key keeps its values while the feature of its name is moved: as with a copy of it for a feature."""
    trial = randomised_trial(spark, 600, 5, seed=4, binary=True).withColumn("part", F.pmod("unit", F.lit(7))).withColumn("copy", F.col("part"))

    def found(name):
        forest = UpliftForest(Experiment(key=("unit", "part"), features=(name, "feature_1")), trees=2, max_depth=2, bins=5)
        return {r["feature"]: r["score"] for r in permutation_importance(trial, forest, repeats=1, buckets=5).collect()}

    own, copied = found("part"), found("copy")
    assert own == pytest.approx({"part": copied["copy"], "feature_1": copied["feature_1"]}) and any(own.values())

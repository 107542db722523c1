"""The forest learns from, and the importance is measured on, counts of equal rows: no more of them than combinations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deltaplane.operators.buckets import near_splits
from deltaplane.operators.evaluate import qini, qini_coefficient
from deltaplane.operators.forest import UpliftForest, permutation_importance, shuffled
from deltaplane.operators.roles import Experiment
from deltaplane.sources.simulate import randomised_trial


def test_a_sample_of_counts(spark):
    """Ten times the rows with keys of their own make no more counts; each tree draws its share of them."""
    few = randomised_trial(spark, 300, 5, seed=4, binary=True)
    many = few.crossJoin(spark.range(10).withColumnRenamed("id", "copy"))
    forest = UpliftForest(Experiment(key=("unit", "copy"), features=("feature_1", "feature_2")), trees=3, bins=4)
    inner = near_splits(many, ["feature_1", "feature_2"], 4, 10_000)
    rows = forest.sample(many, inner).collect()
    assert len(rows) <= 2 * 2 * 4 * 4 and len(rows) == len({(r["t"], r["y"], *r["x"]) for r in rows})
    for k in range(3):
        assert abs(sum(r["w"][k] for r in rows) - 0.63 * 3000) < 150


def test_importance_row_by_row(spark):
    """As moving the features of the rows, scoring and evaluating them; of many features the bins take two numbers."""
    df = randomised_trial(spark, 600, 20, seed=4, binary=True)
    df = df.withColumn("treatment", F.when(F.col("unit") % 10 == 0, 2).otherwise(F.col("treatment"))).withColumn("outcome", F.when(F.col("unit") % 7 > 0, F.col("outcome")))
    names = [f"feature_{i}" for i in range(1, 21)]
    e = Experiment(key=("unit",), features=tuple(names))
    forest = UpliftForest(e, trees=2, max_depth=3, bins=12)
    found = {r["feature"]: r["score"] for r in permutation_importance(df, forest, repeats=1, buckets=7).collect()}
    model = forest.fit(df)
    area = lambda frame: qini_coefficient(qini(model.predict(frame), e.with_(score="uplift"), 7)).first()[0]
    moved = shuffled(df.withColumns({f"own_{f}": F.col(f) for f in names}), names, F.struct("unit"), 1).cache()
    best = sorted(found, key=lambda f: -abs(found[f]))[:3]
    assert len(found) == 20 and all(found[f] for f in best)
    for f in (*best, "feature_20"):
        assert found[f] == pytest.approx(area(df) - area(moved.withColumns({g: F.col(f"own_{g}") for g in names if g != f})), abs=1e-12)

"""Evaluation, learners, selection and sources: invariants, a golden value and edge cases."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from deltaplane import Bootstrap, Experiment, cate, cate_lift, cum_iroi, iroi, qini, roi, target_rate
from deltaplane.functions.draws import hash_split
from deltaplane.functions.features import feature_pipeline
from deltaplane.operators import learners as le
from deltaplane.operators import selection as se
from deltaplane.operators.buckets import quantile_buckets
from deltaplane.operators.evaluate import as_dict, ate, qini_coefficient
from deltaplane.operators.forest import UpliftForest, permutation_importance, shuffled
from deltaplane.plots import bar_data, curve_data, estimate_and_draw
from deltaplane.sources.simulate import randomised_trial

FEATURES = tuple(f"feature_{i}" for i in range(1, 6))


@pytest.fixture(scope="module")
def trial(spark):
    return randomised_trial(spark, 2000, 6, cost_benefit=True, binary=True, seed=3).withColumn("score", F.col("feature_1")).withColumn("bucket", F.when(F.col("feature_1") > 0, "b1").otherwise("b2")).cache()


@pytest.fixture(scope="module")
def e():
    return Experiment(key=("unit",), features=FEATURES)


def r2(rows) -> float:
    mean = sum(r["actual_cate"] for r in rows) / len(rows)
    return 1 - sum((r["actual_cate"] - r["score"]) ** 2 for r in rows) / sum((r["actual_cate"] - mean) ** 2 for r in rows)


def test_ate_and_roi(trial, e):
    rows = trial.collect()
    mean = lambda t: sum(r["outcome"] for r in rows if r["treatment"] == t) / sum(1 for r in rows if r["treatment"] == t)
    got = as_dict(ate(trial, e))
    assert set(got) == {"ate", "target_rate_treated", "target_rate_control"} and abs(got["ate"] - mean(1) + mean(0)) < 1e-9
    assert abs(roi(trial, e).first()["roi"] - sum(r["benefit"] for r in rows) / sum(r["cost"] for r in rows)) < 1e-9
    assert set(iroi(trial, e).columns) == {"iroi", "incremental_benefit", "incremental_cost"}
    b = ate(trial, e, Bootstrap(30)).first()
    assert b["ate_lower"] <= b["ate"] <= b["ate_upper"] and b["ate_std_error"] > 0
    assert b == ate(trial.repartition(7), e, Bootstrap(30)).first() or abs(b["ate_lower"] - ate(trial.repartition(7), e, Bootstrap(30)).first()["ate_lower"]) < 1e-9


@pytest.mark.parametrize("boot", [None, Bootstrap(10)])
def test_shapes_and_sums(trial, e, boot):
    extra = 3 if boot else 0
    for frame, columns in ((target_rate(trial, e, bootstrap=boot), 4), (cate(trial, e, bootstrap=boot), 4), (iroi(trial, e, per_bucket=True, bootstrap=boot), 4)):
        rows = frame.collect()
        assert len(rows) == 2 and len(frame.columns) == columns + extra and sum(r["count"] for r in rows) == 2000 and abs(sum(r["fraction"] for r in rows) - 1) < 1e-9
    for frame in (target_rate(trial, e, 5, bootstrap=boot), cate(trial, e, 5, bootstrap=boot), iroi(trial, e, 5, bootstrap=boot)):
        rows = frame.collect()
        assert [r["bucket"] for r in rows] == [4.0, 3.0, 2.0, 1.0, 0.0] and all(abs(r["count"] - 400) < 2 for r in rows)
    lift, curve, cum = cate_lift(trial, e, 5, boot), qini(trial, e, 5, boot), cum_iroi(trial, e, 5, boot)
    assert (len(lift.columns), lift.count()) == (4 + extra, 5) and (len(curve.columns), curve.count()) == (5 + extra, 6) and (len(cum.columns), cum.count()) == (5 + extra, 5)
    whole = ate(trial, e).first()["ate"]
    assert abs(lift.collect()[-1]["cum_cate"] - whole) < 1e-9 and abs(curve.collect()[-1]["ate"] - whole) < 1e-9
    assert abs(cum.collect()[-1]["iroi"] - iroi(trial, e).first()["iroi"]) < 1e-6
    first = curve.first()
    assert first["bucket"] is None and first["count"] == 0 and first["threshold"] == math.inf
    assert cate(trial, e, 5, labels=True, bootstrap=boot).first()["bucket"].endswith("inf)")
    assert {"x", "y"} <= set(bar_data(cate(trial, e, bootstrap=boot), "cate").columns) and curve_data(curve, "ate").count() == 6


def test_qini_golden(spark):
    rows = [(None, 0.0, 0, 0.0), (2.0, 0.1875, 3, 0.375), (1.0, 0.5, 6, 0.75), (0.0, 0.5, 8, 1.0)]
    assert qini_coefficient(spark.createDataFrame(rows, "bucket double, ate double, count int, fraction double")).first()[0] == 0.0390625


def test_edges(spark, e):
    rows = [(i, 2 if i == 9 else i % 2, None if i == 3 else float(i % 3 == 0), [1.0, None, float("nan")][i % 3] if i < 6 else float(i), "a" if i < 8 else "b", 0.0, 0.0) for i in range(12)] + [(20, 1, 1.0, 5.0, "c", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "unit long, treatment int, outcome double, score double, bucket string, benefit double, cost double")
    by = {r["bucket"]: r for r in cate(df, e).collect()}
    assert by["c"]["cate"] is None and by["c"]["count"] == 1 and roi(df, e).first()["roi"] is None
    assert cate(df, e, 3).agg(F.sum("count")).first()[0] == 9  # null and NaN scores are left out
    kept, inner = quantile_buckets(spark.range(10).select(F.col("id").cast("double").alias("s")), "s", 5)
    assert inner == [1.0, 3.0, 5.0, 7.0] and kept.count() == 10
    assert ate(df.limit(0), e).first()["ate"] is None
    with pytest.raises(ValueError):
        ate(df, e.with_(outcome="none"))
    with pytest.raises(ValueError):
        ate(df, e, Bootstrap(5)) if not e.with_(key=()).key and e.key == () else ate(df, e.with_(key=()), Bootstrap(5))
    with pytest.raises(ValueError):
        ate(df, e.with_(treated="1"))


def test_learners(spark, e):
    df = randomised_trial(spark, 3000, seed=5).cache()
    line = le.Base(LinearRegression)
    for learner in (le.TLearner(line, e), le.XLearner(line, e), le.RLearner(line, e), le.SLearner(le.Base(DecisionTreeRegressor, {"maxDepth": 8}), e), le.TransformedOutcome(line, e), le.TransformedOutcome(line, e, propensity=le.Base(LogisticRegression))):
        out = learner.fit(df).predict(df)
        assert out.columns == [*df.columns, "score"] and out.count() == 3000 and r2(out.collect()) > 0, learner
        assert learner.fit(df).predict(df.drop("treatment", "outcome")).columns[-1] == "score"
    p = le.Propensity(e).fit(df).predict(df.drop("propensity"))
    assert abs(p.first()["propensity"] - 0.5) < 0.05


def test_classifiers(trial, e):
    base, df = le.Base(LogisticRegression), trial.drop("score")
    out = le.ClassTransformation(base, e).fit(df).predict(df)
    assert r2(out.collect()) > 0
    rows = le.Retrospective(base, e).fit(df).predict(df).where("outcome = 1").select("treatment", "score").collect()
    pos, neg = [r["score"] for r in rows if r["treatment"] == 1], [r["score"] for r in rows if r["treatment"] == 0]
    assert sum(a > b for a in pos for b in neg) / (len(pos) * len(neg)) > 0.5
    one = le.TLearner(base, e).fit(df.withColumn("outcome", F.lit(1)))
    assert one.predict(df).count() == df.count()


def test_forest(trial, e):
    forest = UpliftForest(e, trees=5, max_depth=4, bins=10, output="score")
    out = forest.fit(trial).predict(trial.drop("score"))
    rows = out.collect()
    assert len(rows) == 2000 and r2(rows) > 0
    moved = shuffled(trial, "feature_1", F.col("unit"), 1)
    assert sorted(r[0] for r in moved.select("feature_1").collect()) == sorted(r[0] for r in trial.select("feature_1").collect())
    assert moved.columns == trial.columns


def test_selection(spark, trial, e):
    names = [f"feature_{i}" for i in range(1, 7)]
    for found in (se.divergence_filter(trial, e, names), se.divergence_filter(trial, e, names, method="ED"), se.uplift_curve_filter(trial, e, names), se.niv_filter(trial, e, names)):
        rows = found.collect()
        assert found.columns == ["feature", "score"] and len(rows) == 6 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert se.divergence_bins(trial, e, names).groupBy("feature").count().where("count = 10").count() == 6
    with pytest.raises(ValueError):
        se.divergence_bins(trial, e, names, method="none")
    few = spark.createDataFrame([(1, 1, 1.0), (0, 0, 1.0), (1, 0, None), (0, 1, None)], "treatment int, outcome int, f double")
    assert {r["bin"]: r["contribution"] for r in se.divergence_bins(few, e, ["f"]).collect()}[None] == 0.0
    assert se.divergence_bins(few, e, ["f"], smooth=False).where("bin = 1").first()["contribution"] is None
    scores = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 3.0)], "feature string, x double, y double")
    assert [tuple(r) for r in se.min_max(scores, ["x", "y"]).collect()] == [(0.0, None), (1.0, None)]
    assert [r["weighted_score"] for r in se.linear_weighting(scores, ["x", "y"]).collect()] == [4.0, 3.5]


def test_validation_rows(spark, e):
    df = randomised_trial(spark, 2000, seed=9)
    train, held = hash_split(df, [3, 1], "unit")
    boosted = le.Base(GBTRegressor, {"maxIter": 5, "maxDepth": 3, "seed": 1})
    for learner in (le.SLearner(boosted, e), le.TLearner(boosted, e), le.XLearner(le.Base(LinearRegression), e), le.TransformedOutcome(boosted, e), le.RLearner(le.Base(LinearRegression), e)):
        out = learner.fit(train, held).predict(held)
        assert out.columns == [*df.columns, "score"] and out.where("score is null").isEmpty(), learner
    line = le.TLearner(le.Base(LinearRegression), e)
    a, b = (m.predict(held).orderBy("unit").first()["score"] for m in (line.fit(train), line.fit(train, held)))
    assert abs(a - b) < 1e-9  # without a use for them, validation rows change nothing


def test_shares_and_features(spark, e):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "b"), (4, 0, None)], "unit long, treatment int, kind string")
    rows = le.Propensity(e, own_arm_share=True).fit(df).predict(df).orderBy("unit").collect()
    assert [r["propensity"] for r in rows] == [0.75, 0.75, 0.75, 0.25]
    out = feature_pipeline(["kind"], ["unit"]).fit(df).transform(df).orderBy("unit").collect()
    assert [r["kind_index"] for r in out] == [1.0, 0.0, 0.0, 2.0] and out[0]["features"].toArray().tolist()[-1] == 1.0


def test_forest_sampling(trial, e):
    forest = UpliftForest(e, trees=3, max_depth=3, bins=8, features_per_split=2, tree_feature_rate=0.8, arm_rates=(0.5, 0.7), metric="euclidean")
    assert forest.fit(trial).predict(trial).where("uplift is null").isEmpty()
    found = permutation_importance(trial, forest, repeats=1, buckets=5, samples=500).collect()
    assert sorted(r["feature"] for r in found) == sorted(FEATURES)
    with pytest.raises(ValueError):
        forest.fit(trial.withColumn("outcome", F.col("unit")))
    with pytest.raises(ValueError):
        UpliftForest(e, metric="none").fit(trial)


class Axes:
    """Notes what is drawn."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.append((name, k.get("label")))


def test_drawing(trial, e):
    for kind, options, first in (("cate", {}, "bar"), ("cate", {"quantiles": 4, "bootstrap": Bootstrap(5)}, "errorbar"), ("iroi", {"per_bucket": True}, "bar"), ("target_rate", {}, "bar"), ("cate_lift", {"buckets": 4}, "plot"), ("cum_iroi", {"buckets": 4, "bootstrap": Bootstrap(5)}, "plot")):
        ax = Axes()
        assert estimate_and_draw(trial, e, kind, ax, **options).count() > 0 and ax.calls[0][0] == first
    ax = Axes()
    curve = estimate_and_draw(trial, e, "qini", ax, label="a", buckets=4)
    assert ax.calls[0] == ("plot", f"a: {qini_coefficient(curve).first()[0]:.4f}")
    with pytest.raises(ValueError):
        estimate_and_draw(trial, e, "none", ax)


def test_queries_without_the_optional_part(spark):
    from deltaplane.plans import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert queries.queries()["ate"](spark, "/root/testdata/sf0.001").count() == 1

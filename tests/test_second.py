"""Arms of any type, text features, smoothing, the simulator's streams, forest parameters, plots and a started stream."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deltaplane import Experiment, cum_iroi, iroi
from deltaplane.functions.storage import stored
from deltaplane.operators import selection as se
from deltaplane.operators.forest import UpliftForest, permutation_importance, shuffled
from deltaplane.plots import contribution_data, draw_contributions, draw_importance, importance_data
from deltaplane.sources.simulate import randomised_trial
from deltaplane.streaming.monitor import effect_by_window

NAMES = [f"feature_{i}" for i in range(1, 6)]


@pytest.fixture(scope="module")
def trial(spark):
    return randomised_trial(spark, 1500, 5, binary=True, cost_benefit=True, seed=11).withColumn("score", F.col("feature_1")).cache()


def test_arms_of_any_type(trial):
    """The scores depend on the arms, not on how they are written."""
    e = Experiment()
    own = {"double": (trial.withColumn("treatment", F.col("treatment").cast("double")), e), "text": (trial.withColumn("treatment", F.when(F.col("treatment") == 1, "a").otherwise("b")), e.with_(treated="a", control="b"))}
    for operator in (se.divergence_filter, se.uplift_curve_filter, se.niv_filter):
        want = {r["feature"]: r["score"] for r in operator(trial, e, NAMES).collect()}
        assert any(abs(x) > 1e-6 for x in want.values())
        for kind, (frame, roles) in own.items():
            got = {r["feature"]: r["score"] for r in operator(frame, roles, NAMES).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), (operator, kind)
    with pytest.raises(ValueError):
        se.niv_filter(trial, e.with_(treated="1"), NAMES)


def test_text_features(trial):
    frame = trial.withColumn("kind", F.when(F.col("feature_1") > 0, "high").otherwise("low"))
    bins = se.divergence_bins(frame, Experiment(), ["kind", "feature_2"]).collect()
    assert {r["bin"] for r in bins if r["feature"] == "kind"} == {"high", "low"} and sum(r["feature"] == "feature_2" for r in bins) == 10
    as_number = se.niv_filter(frame.withColumn("kind", (F.col("feature_1") > 0).cast("int")), Experiment(), ["kind"]).first()["score"]
    assert abs(se.niv_filter(frame, Experiment(), ["kind"]).first()["score"] - as_number) < 1e-12


def test_simulator_is_keyed(spark):
    """The rows are the same on any partitioning, and no column repeats another one's numbers."""
    df = randomised_trial(spark, 4000, 6, seed=2)
    rows = {r["unit"]: tuple(r) for r in df.collect()}
    assert {r["unit"]: tuple(r) for r in df.repartition(3).collect()} == rows
    values = [{round(r[df.columns.index(f"feature_{i}")], 9) for r in rows.values()} for i in range(1, 7)]
    assert all(not values[i] & values[j] for i in range(6) for j in range(i))
    pairs = [(f"feature_{i}", f"feature_{j}") for i in range(1, 7) for j in range(1, i)]
    assert all(abs(x) < 0.08 for x in df.agg(*[F.corr(a, b) for a, b in pairs]).first())
    means = df.agg(*[F.avg(f"feature_{i}") for i in range(1, 7)], *[F.stddev(f"feature_{i}") for i in range(1, 7)]).first()
    assert all(abs(m) < 0.08 for m in means[:6]) and all(abs(s - 1) < 0.08 for s in means[6:])


def test_negative_cost(trial):
    e = Experiment(key=("unit",))
    flipped = trial.withColumn("cost", -F.col("cost"))
    assert iroi(trial, e, details=True).first()["negative_cost"] is False and iroi(flipped, e, details=True).first()["negative_cost"] is True
    rows = iroi(flipped, e, 4, details=True).collect()
    assert {"incremental_cost", "negative_cost"} <= set(rows[0].asDict()) and all(r["negative_cost"] == (r["incremental_cost"] < 0) for r in rows)
    assert cum_iroi(flipped, e, 4, details=True).columns[-1] == "negative_cost"


def test_forest_parameters(spark, trial):
    e = Experiment(key=("unit",), features=(*NAMES, "flat"))
    frame = trial.withColumn("flat", F.lit(1.0))
    deep = UpliftForest(e, trees=3, max_depth=10, bins=8, top_bins=32, min_rows=5, features_per_split=1)
    model = deep.fit(frame)
    assert max(len(t.feature) for t in model.trees) > 15 and all(5 not in t.feature for t in model.trees)
    for t in model.trees:
        assert all(c > i for i, c in enumerate(t.child) if t.feature[i] >= 0) and t.uplift[0] != 0
    assert model.auuc(frame, "gain", 5) == pytest.approx(1500 * model.auuc(frame, "qini", 5))
    assert model.auuc(frame, "lift", 5) is not None
    with pytest.raises(ValueError):
        model.auuc(frame, "none")
    # A stump's split is the best one by plain search over the bins.
    stump = UpliftForest(e.with_(features=tuple(NAMES)), trees=1, max_depth=1, bins=6, sample_rate=1.0, metric="euclidean").fit(trial)
    rows, best = trial.collect(), (0.0,)
    for i, f in enumerate(NAMES):
        for b, cut in enumerate(stump.inner[f]):
            gain = 0.0
            for side in (lambda v, c=cut: v < c, lambda v, c=cut: v >= c):
                own = [r for r in rows if side(r[f])]
                p = [sum(r["outcome"] for r in own if r["treatment"] == t) / max(1, sum(r["treatment"] == t for r in own)) for t in (0, 1)]
                gain += len(own) * 2 * (p[1] - p[0]) ** 2
            best = max(best, (gain, -i, -b))
    assert (stump.trees[0].feature[0], stump.trees[0].bin[0]) == (-best[1], -best[2])


def test_moved_together(spark, trial):
    """Several columns move by one permutation; the frame is stored, so that ranks stay."""
    moved = stored(shuffled(trial.select("unit", "feature_1", F.col("feature_1").alias("twin")), ["feature_1", "twin"], F.col("unit"), 3))
    assert moved.where("feature_1 <> twin").isEmpty() and moved.count() == 1500
    assert moved.join(trial.select("unit", F.col("feature_1").alias("own")), "unit").where("own = feature_1").count() < 20
    found = permutation_importance(trial, UpliftForest(Experiment(key=("unit",), features=tuple(NAMES)), trees=2, max_depth=2, bins=5), repeats=1, buckets=5)
    assert sorted(r["feature"] for r in found.collect()) == NAMES


class Axes:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.append((name, *a))


def test_selection_plots(trial):
    scores = se.niv_filter(trial, Experiment(), NAMES)
    rows = importance_data(scores).collect()
    assert [r["y"] for r in rows] == sorted(r["y"] for r in rows)
    ax = Axes()
    draw_importance(scores, ax)
    assert ax.calls[0][0] == "barh"
    bins = se.niv_bins(trial, Experiment(), NAMES[:2])
    assert contribution_data(bins, "feature_1").count() == 10
    axes = draw_contributions(bins, {n: Axes() for n in NAMES[:2]})
    assert [c[0] for c in axes["feature_2"].calls] == ["bar", "set_title"]


def test_started_stream(spark, tmp_path):
    """Windows close as the watermark passes them; rows that come later than allowed are left out."""
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [[(at(1, 5), 1, 1), (at(1, 10), 0, 0)], [(at(4, 0), 1, 1)], [(at(1, 20), 1, 0), (at(4, 10), 0, 1)], [(at(9, 0), 1, 1)], [(at(9, 30), 0, 0)]]
    schema = "ts timestamp, treatment int, outcome int"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/staged/{i}")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = effect_by_window(stream, Experiment(), "ts").writeStream.format("memory").queryName("effects").outputMode("append").start()
    try:
        for i in range(len(batches)):
            part = next((tmp_path / "staged" / str(i)).glob("part-*.parquet"))
            part.rename(tmp_path / "in" / f"{i}.parquet")
            query.processAllAvailable()
        got = {r["start"].hour: (r["n"], r["ate"]) for r in spark.table("effects").collect()}
    finally:
        query.stop()
    assert got == {1: (2, 1.0), 4: (2, 0.0)}

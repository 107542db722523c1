"""Numbers to plot, and plots where matplotlib is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaplane.operators import evaluate as ev
from deltaplane.operators.roles import Experiment


def bar_data(result: DataFrame, metric: str, bucket: str = "bucket") -> DataFrame:
    """x, y and, with intervals, err_low and err_high; highest first."""
    errors = [(F.col(metric) - F.col(f"{metric}_lower")).alias("err_low"), (F.col(f"{metric}_upper") - F.col(metric)).alias("err_high")] if f"{metric}_lower" in result.columns else []
    return result.select(F.col(bucket).alias("x"), F.col(metric).alias("y"), *errors).orderBy(F.desc("y"))


def curve_data(result: DataFrame, metric: str, x: str = "fraction") -> DataFrame:
    """x, y, overall (y at the largest x), diagonal (x times overall) and bounds where there are any."""
    overall = result.agg(F.max_by(metric, x)).first()[0]
    bounds = [F.col(f"{metric}_lower").alias("low"), F.col(f"{metric}_upper").alias("high")] if f"{metric}_lower" in result.columns else []
    return result.select(F.col(x).alias("x"), F.col(metric).alias("y"), F.lit(overall).alias("overall"), (F.col(x) * F.lit(overall)).alias("diagonal"), *bounds).orderBy("x")


def importance_data(scores: DataFrame, feature: str = "feature", score: str = "score") -> DataFrame:
    """x, y: features and scores, the lowest first, as horizontal bars are stacked from below."""
    return scores.select(F.col(feature).alias("x"), F.col(score).alias("y")).orderBy("y", F.desc("x"))


def contribution_data(contributions: DataFrame, feature: str | None = None) -> DataFrame:
    """feature, x (the bin), y: the contributions of the bins of one feature, or of all, by feature and bin."""
    own = contributions if feature is None else contributions.where(F.col("feature") == feature)
    return own.select("feature", F.col("bin").alias("x"), F.col("contribution").alias("y")).orderBy("feature", "x")


def draw_importance(scores: DataFrame, ax=None):
    """Draws a score table as horizontal bars, the highest on top."""
    if ax is None:
        import matplotlib.pyplot as plt

        ax = plt.gca()
    rows = importance_data(scores).toPandas()
    ax.barh(rows["x"], rows["y"])
    return ax


def draw_contributions(contributions: DataFrame, axes: dict | None = None) -> dict:
    """Draws the bins' contributions of each feature, on its own axes if none are given by feature."""
    rows, axes = contribution_data(contributions).toPandas(), dict(axes or {})
    for name, own in rows.groupby("feature", sort=True):
        if name not in axes:
            import matplotlib.pyplot as plt

            axes[name] = plt.subplots()[1]
        axes[name].bar([str(round(x, 4)) if isinstance(x, float) else str(x) for x in own["x"]], own["y"])
        axes[name].set_title(name)
    return axes


def draw(data: DataFrame, label: str | None = None, ax=None):
    """Draws bar_data or curve_data: points with error bars or bars, or a curve with its band and reference."""
    if ax is None:
        import matplotlib.pyplot as plt

        ax = plt.gca()
    rows = data.toPandas()
    if "overall" in rows:
        ax.plot(rows["x"], rows["y"], label=label)
        ax.plot(rows["x"], rows["diagonal"], linestyle="--", color="grey")
        if "low" in rows:
            ax.fill_between(rows["x"], rows["low"], rows["high"], alpha=0.2)
    elif "err_low" in rows:
        ax.errorbar(rows["x"].astype(str), rows["y"], yerr=[rows["err_low"], rows["err_high"]], fmt="o", label=label)
    else:
        ax.bar(rows["x"].astype(str), rows["y"], label=label)
    return ax


#: What can be estimated and drawn in one call: the operator, its main column, whether it is a curve.
KINDS = {
    "target_rate": (ev.target_rate, "target_rate", False), "cate": (ev.cate, "cate", False), "iroi": (ev.iroi, "iroi", False),
    "cate_lift": (ev.cate_lift, "cum_cate", True), "qini": (ev.qini, "ate", True), "cum_iroi": (ev.cum_iroi, "iroi", True),
}


def estimate_and_draw(df: DataFrame, e: Experiment, kind: str, ax=None, label: str = "", **options) -> DataFrame:
    """Draws an evaluation of one of KINDS and returns it. options go to the operator; a Qini label shows the coefficient."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind!r}")
    operator, metric, curve = KINDS[kind]
    out = operator(df, e, **options)
    if kind == "qini":
        label = f"{label or 'qini'}: {ev.qini_coefficient(out).first()[0]:.4f}"
    draw(curve_data(out, metric) if curve else bar_data(out, metric), label or None, ax)
    return out

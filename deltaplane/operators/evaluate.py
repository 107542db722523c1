"""Treatment effects, returns and curves from additive statistics, with pivotal bootstrap intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaplane.functions.draws import fast_uniform, poisson, portable_uniform
from deltaplane.operators.buckets import label_of, quantile_buckets, threshold_of
from deltaplane.operators.roles import Experiment


@dataclass(frozen=True)
class Bootstrap:
    """Poisson resampling: draw 0 is the sample itself, so there are `draws` - 1 resamples."""

    draws: int = 100
    low: float = 0.025
    high: float = 0.975
    seed: int = 0
    #: Draws that other SQL engines can repeat.
    portable: bool = False


#: Each metric: its statistics and its columns, the first the main one.
STATISTICS = {
    "ate": ("n_t", "n_c", "y_t", "y_c"),
    "target_rate": ("y",),
    "roi": ("b", "k"),
    "iroi": ("n_t", "n_c", "b_t", "b_c", "k_t", "k_c"),
}


def _terms(e: Experiment, w: Column) -> dict[str, Column]:
    zero = lambda c, x: F.coalesce(F.sum(F.when(c, F.coalesce(x, F.lit(0.0)) * w)), F.lit(0.0))
    y, b, k = (F.col(c).cast("double") for c in (e.outcome, e.benefit, e.cost))
    t, c, every = e.is_treated, e.is_control, F.lit(True)
    return {
        "n": F.coalesce(F.sum(w), F.lit(0)).cast("long"),
        "n_t": zero(t, F.lit(1.0)), "n_c": zero(c, F.lit(1.0)),
        "y_t": zero(t, y), "y_c": zero(c, y), "y": zero(every, y),
        "b_t": zero(t, b), "b_c": zero(c, b), "b": zero(every, b),
        "k_t": zero(t, k), "k_c": zero(c, k), "k": zero(every, k),
    }


def statistics(df: DataFrame, e: Experiment, metric: str, keys: list[str], weight: Column | None = None) -> DataFrame:
    """The sums that the metric needs for each group of the keys: one aggregate with map-side partial sums."""
    terms = _terms(e, F.lit(1) if weight is None else weight)
    own = [terms[s].alias(f"__{s}") for s in ("n", *STATISTICS[metric])]
    return df.groupBy(*keys).agg(*own) if keys else df.agg(*own)


def ratios(metric: str) -> dict[str, Column]:
    """The metric's columns from its statistics; null where a divisor is 0."""
    s = lambda name: F.col(f"__{name}")
    if metric == "ate":
        treated, control = F.try_divide(s("y_t"), s("n_t")), F.try_divide(s("y_c"), s("n_c"))
        return {"ate": treated - control, "target_rate_treated": treated, "target_rate_control": control}
    if metric == "target_rate":
        return {"target_rate": F.try_divide(s("y"), s("n").cast("double"))}
    if metric == "roi":
        return {"roi": F.try_divide(s("b"), s("k"))}
    scale = F.try_divide(s("n_t"), s("n_c"))
    benefit, cost = s("b_t") - s("b_c") * scale, s("k_t") - s("k_c") * scale
    return {"iroi": F.try_divide(benefit, cost), "incremental_benefit": benefit, "incremental_cost": cost}


def evaluate(df: DataFrame, e: Experiment, metric: str, bucket: str | None = None, cumulative: bool = False, bootstrap: Bootstrap | None = None, main_only: bool = False, scaled: bool = False, details: bool = False) -> DataFrame:
    """The metric of all rows or of each bucket: [bucket, count, fraction,] its columns; with a bootstrap also
    `_lower`, `_upper` and `_std_error` of each.

    cumulative: of the bucket and all higher ones. scaled: the metric times the fraction. details: all columns of the
    metric by bucket too, and for iroi the flag `negative_cost`. Null outcomes count as 0 in sums and as rows in counts. Rows of other arms count in count and fraction only. Draws depend on the key alone.
    """
    e.check(df, *(("treatment",) if metric in ("ate", "iroi") else ()), *({"ate": ("outcome",), "target_rate": ("outcome",)}.get(metric, ("benefit", "cost"))))
    keys = ["__bucket"] if bucket else []
    roles = [c for c in dict.fromkeys((e.treatment, e.outcome, e.benefit, e.cost)) if c in df.columns]
    missing = [c for c in dict.fromkeys((e.treatment, e.outcome, e.benefit, e.cost)) if c not in df.columns]
    rows = df.select(*roles, *[F.lit(None).cast("double").alias(c) for c in missing], *([F.col(bucket).alias("__bucket")] if bucket else []), *([F.struct(*e.key).alias("__key")] if e.key else []))
    if missing and e.treatment in missing:
        e = e.with_(treated=1.0, control=0.0)
    weight = None
    if bootstrap:
        if not e.key:
            raise ValueError("a bootstrap needs the key of the units")
        rows = rows.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(bootstrap.draws - 1))))
        uniform = portable_uniform(F.concat_ws("|", *[F.col("__key")[c].cast("string") for c in e.key]), F.col("__draw")) if bootstrap.portable else fast_uniform(bootstrap.seed, F.col("__key"), F.col("__draw"))
        # Columns of their own: within the sums the hash would be taken anew for each of them.
        rows = rows.withColumn("__u", uniform).drop("__key").withColumn("__w", F.when(F.col("__draw") == 0, 1).otherwise(poisson(F.col("__u")))).drop("__u")
        weight = F.col("__w")
        keys.append("__draw")
    sums = statistics(rows, e, metric, keys, weight)
    # From here on there are as many rows as buckets and draws.
    whole = Window.partitionBy(*(["__draw"] if bootstrap else []))
    if bucket:
        sums = sums.withColumn("__f", F.try_divide(F.col("__n").cast("double"), F.sum("__n").over(whole)))
        if cumulative:
            up = whole.orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
            sums = sums.withColumns({c: F.sum(c).over(up) for c in sums.columns if c not in ("__bucket", "__draw")})
    columns = dict(list(ratios(metric).items())[: 1 if main_only or bucket and not details else None])
    if scaled:
        columns = {c: x * F.col("__f") for c, x in columns.items()}
    points = sums.select(*([F.col("__bucket"), F.col("__n"), F.col("__f")] if bucket else []), *([F.col("__draw")] if bootstrap else []), *[x.alias(c) for c, x in columns.items()])
    shown = [F.col("__bucket").alias("bucket"), F.col("__n").alias("count"), F.col("__f").alias("fraction")] if bucket else []
    flag = [(F.col("incremental_cost") < 0).alias("negative_cost")] if details and "incremental_cost" in columns else []
    if not bootstrap:
        return points.select(*shown, *columns, *flag)
    return interval(points, list(columns), ["__bucket"] if bucket else [], bootstrap, ["__n", "__f"] if bucket else []).select(*shown, *[c + s for c in columns for s in ("", "_lower", "_upper", "_std_error")], *flag)


def interval(points: DataFrame, columns: list[str], by: list[str], b: Bootstrap, carried: list[str]) -> DataFrame:
    """Pivotal intervals from the metric of each draw: with d the draws' deviations from the sample, [x - d_high, x - d_low]."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    own = F.col("__draw") == 0
    with_sample = points.withColumns({f"__0_{c}": F.max(F.when(own, F.col(c))).over(group) for c in columns})
    out = []
    for c in columns:
        d = F.when(~own, F.col(c) - F.col(f"__0_{c}"))
        q = F.percentile_approx(d, [b.low, b.high], 10_000)
        out += [F.max(f"__0_{c}").alias(c), (F.max(f"__0_{c}") - q[1]).alias(f"{c}_lower"), (F.max(f"__0_{c}") - q[0]).alias(f"{c}_upper"), F.sqrt(F.avg(d * d)).alias(f"{c}_std_error")]
    return with_sample.groupBy(*by).agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in carried], *out)


def _bucketed(df: DataFrame, e: Experiment, metric: str, name: str, bootstrap: Bootstrap | None, buckets: int | None, labels: bool, accuracy: int = 1_000_000, details: bool = False) -> DataFrame:
    inner: list[float] = []
    if buckets:
        df, inner = quantile_buckets(df, e.score, buckets, "__quantile", accuracy)
    out = evaluate(df, e, metric, "__quantile" if buckets else e.bucket, bootstrap=bootstrap, details=details)
    main = next(iter(ratios(metric)))
    out = out.select(*[F.col(c).alias(c.replace(main, name, 1) if c.startswith(main) else c) for c in out.columns]).orderBy(F.desc("bucket"))
    return out.withColumn("bucket", label_of(F.col("bucket"), inner)) if buckets and labels else out


def ate(df: DataFrame, e: Experiment, bootstrap: Bootstrap | None = None) -> DataFrame:
    """One row: average treatment effect and the target rates of both arms."""
    return evaluate(df, e, "ate", bootstrap=bootstrap)


def target_rate(df: DataFrame, e: Experiment, quantiles: int | None = None, labels: bool = False, bootstrap: Bootstrap | None = None) -> DataFrame:
    """Target rate of each bucket, or of each of so many quantiles of the score."""
    return _bucketed(df, e, "target_rate", "target_rate", bootstrap, quantiles, labels)


def cate(df: DataFrame, e: Experiment, quantiles: int | None = None, labels: bool = False, bootstrap: Bootstrap | None = None) -> DataFrame:
    """Treatment effect of each bucket, or of each quantile of the score."""
    return _bucketed(df, e, "ate", "cate", bootstrap, quantiles, labels)


def iroi(df: DataFrame, e: Experiment, quantiles: int | None = None, per_bucket: bool = False, labels: bool = False, bootstrap: Bootstrap | None = None, details: bool = False) -> DataFrame:
    """Incremental return on investment: of all rows (one row), of each bucket, or of each quantile of the score.

    A negative incremental cost is reported as it is, no sign is changed; `details` adds incremental benefit and cost
    to buckets, and the flag `negative_cost` (null where there is no cost).
    """
    if quantiles or per_bucket:
        return _bucketed(df, e, "iroi", "iroi", bootstrap, quantiles, labels, details=details)
    return evaluate(df, e, "iroi", bootstrap=bootstrap, details=details)


def roi(df: DataFrame, e: Experiment, bootstrap: Bootstrap | None = None) -> DataFrame:
    """Return on investment of all rows: one row."""
    return evaluate(df, e, "roi", bootstrap=bootstrap)


def cate_lift(df: DataFrame, e: Experiment, buckets: int = 30, bootstrap: Bootstrap | None = None) -> DataFrame:
    """Cumulative effect from the highest scores down: bucket, count, fraction, cum_cate."""
    rows, _ = quantile_buckets(df, e.score, buckets, "__quantile")
    out = evaluate(rows, e, "ate", "__quantile", cumulative=True, bootstrap=bootstrap)
    return out.select(*[F.col(c).alias("cum_c" + c if c.startswith("ate") else c) for c in out.columns]).orderBy(F.desc("bucket"))


def qini(df: DataFrame, e: Experiment, buckets: int = 30, bootstrap: Bootstrap | None = None) -> DataFrame:
    """Cumulative effect times cumulative fraction, with the lower score of each bucket and a zero row at the start."""
    rows, inner = quantile_buckets(df, e.score, buckets, "__quantile")
    out = evaluate(rows, e, "ate", "__quantile", cumulative=True, bootstrap=bootstrap, scaled=True)
    out = out.withColumn("threshold", threshold_of(F.col("bucket"), inner))
    named = [c for c in out.columns if c not in ("bucket", "count", "fraction", "threshold")]
    out = out.select("bucket", "count", "fraction", "threshold", *named)
    zero = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("bucket"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("fraction"), F.lit(float("inf")).alias("threshold"), *[F.lit(0.0).alias(c) for c in named])
    return zero.unionByName(out).orderBy("fraction")


def cum_iroi(df: DataFrame, e: Experiment, buckets: int = 30, bootstrap: Bootstrap | None = None, details: bool = False) -> DataFrame:
    """Cumulative incremental return from the highest scores down: bucket, count, fraction, threshold, iroi; details: see iroi."""
    rows, inner = quantile_buckets(df, e.score, buckets, "__quantile")
    out = evaluate(rows, e, "iroi", "__quantile", cumulative=True, bootstrap=bootstrap, details=details)
    out = out.withColumn("threshold", threshold_of(F.col("bucket"), inner))
    named = [c for c in out.columns if c not in ("bucket", "count", "fraction", "threshold")]
    return out.select("bucket", "count", "fraction", "threshold", *named).orderBy(F.desc("bucket"))


def auuc(curve: DataFrame, x: str = "fraction", y: str = "ate") -> DataFrame:
    """One row: area under the curve by trapezoids. A curve has a row for each bucket, so one task orders it."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)
    steps = curve.select(x, y, F.lag(x).over(w).alias("__x"), F.lag(y).over(w).alias("__y"))
    return steps.agg(F.sum((F.col(x) - F.col("__x")) * (F.col(y) + F.col("__y")) / 2).alias("auuc"))


def qini_coefficient(curve: DataFrame, x: str = "fraction", y: str = "ate") -> DataFrame:
    """One row: area under the curve less that under the straight line from its first to its last point."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)
    steps = curve.select(x, y, F.lag(x).over(w).alias("__x"), F.lag(y).over(w).alias("__y"))
    area = F.sum((F.col(x) - F.col("__x")) * (F.col(y) + F.col("__y")) / 2)
    line = (F.max(x) - F.min(x)) * (F.max_by(y, x) + F.min_by(y, x)) / 2
    return steps.agg((area - line).alias("qini_coefficient"))


def as_dict(one_row: DataFrame) -> dict[str, float]:
    """The values of a one-row result."""
    return one_row.first().asDict()

"""Feature selection: binning, divergence, uplift-curve and net-information-value filters, and score utilities."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaplane.operators.buckets import bucket_of, splits
from deltaplane.operators.roles import Experiment

#: Probabilities stay this far from 0 and 1; an empty cell's weight of evidence.
EPSILON, NO_EVIDENCE = 1e-6, 10.0


#: The two arms in the cells, whatever their values in the frame; other arms are `other:` and their value.
TREATED, CONTROL = "treated", "control"


def _is_text(df: DataFrame, feature: str) -> bool:
    return df.schema[feature].dataType.simpleString() in ("string", "date", "timestamp", "timestamp_ntz")


def discretise(df: DataFrame, features: list[str], bins: int = 10, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """df with each feature of more than `bins` distinct values replaced by its quantile bin; null and NaN become null.

    Text features stay as they are: each value is a bin. Three passes over the frame, whatever the number of features;
    the sketches of all features meet in one task, so their accuracy bounds its memory (features x accuracy). The splits
    are exact, whatever the accuracy.
    """
    features = [f for f in features if not _is_text(df, f)]
    if bins < 1 or not features:
        return df
    distinct = F.count_distinct if exact else F.approx_count_distinct
    counts = df.agg(*[distinct(f).alias(str(i)) for i, f in enumerate(features)]).first()
    many = [f for i, f in enumerate(features) if counts[i] > bins]
    inner = splits(df, many, bins, accuracy) if many else {}
    return df.withColumns({f: bucket_of(F.col(f).cast("double"), inner[f]) for f in many})


def cells(df: DataFrame, e: Experiment, features: list[str]) -> DataFrame:
    """feature, bin, t (see TREATED), y (0/1), n: all features in one aggregate over the unpivoted frame.

    bin is a number, or text if any of the features is (numbers as Spark writes them).
    """
    e.check(df, "treatment", "outcome")
    own = df.where(F.col(e.outcome).isNotNull() & F.col(e.treatment).isNotNull())
    text = any(_is_text(df, f) for f in features)
    value = {f: F.col(f).cast("string") if _is_text(df, f) else F.col(f).cast("double").cast("string" if text else "double") for f in features}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), value[f].alias("bin")) for f in features]))
    rows = own.select(_arm(e).alias("t"), F.col(e.outcome).cast("int").alias("y"), pairs.alias("x"))
    return rows.groupBy(F.col("x.feature").alias("feature"), F.col("x.bin").alias("bin"), "t", "y").agg(F.count(F.lit(1)).alias("n"))


def _arm(e: Experiment) -> Column:
    return F.when(e.is_treated, TREATED).when(e.is_control, CONTROL).otherwise(F.concat(F.lit("other:"), F.col(e.treatment).cast("string")))


def divergence(p: Column, q: Column, method: str) -> Column:
    """Distance of two outcome rates: KL, ED (Euclidean) or Chi; null if a rate is."""
    if method == "KL":
        known = p.isNotNull() & q.isNotNull()
        p, q = (F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1 - EPSILON)) for x in (p, q))
        return F.when(known, p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q)))
    if method == "ED":
        return 2 * (p - q) * (p - q)
    if method == "Chi":
        return (p - q) * (p - q) / F.greatest(F.lit(EPSILON), q) + (p - q) * (p - q) / F.greatest(F.lit(EPSILON), 1 - q)
    raise ValueError(f"method must be KL, ED or Chi, not {method!r}")


def divergence_bins(df: DataFrame, e: Experiment, features: list[str], bins: int = 10, method: str = "KL", smooth: bool = True) -> DataFrame:
    """feature, bin, contribution: the divergence of the bin's arms times its share of the rows.

    `smooth`: a cell of an arm and outcome that both occur in the bin, but not together, counts one row. Without it such
    a bin has no contribution (null). The divergence is summed over all arms but the control.
    """
    divergence(F.lit(0.5), F.lit(0.5), method)
    found = cells(discretise(df, features, bins), e, features)
    return _divergences(found, e, method, smooth, ["feature", "bin"], "contribution")


def _divergences(found: DataFrame, e: Experiment, method: str, smooth: bool, keys: list[str], name: str) -> DataFrame:
    arms = found.groupBy(*keys, "t").agg(F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("n0"), F.sum("n").alias("n"))
    groups = arms.groupBy(*keys).agg(F.collect_list(F.struct("t", "n1", "n0")).alias("arms"), F.sum("n").alias("size"), F.max(F.col("n1").isNotNull()).alias("any1"), F.max(F.col("n0").isNotNull()).alias("any0"))
    empty = F.lit(1 if smooth else None).cast("long")

    def rate(a: Column) -> Column:
        n1 = F.coalesce(a["n1"], F.when(F.col("any1"), empty).otherwise(0 if smooth else None))
        n0 = F.coalesce(a["n0"], F.when(F.col("any0"), empty).otherwise(0 if smooth else None))
        return F.try_divide(n1.cast("double"), n1 + n0)

    control = F.filter("arms", lambda a: a["t"] == CONTROL)
    others = F.filter("arms", lambda a: a["t"] != CONTROL)
    total = F.aggregate(others, F.lit(0.0), lambda s, a: s + divergence(rate(a), rate(F.get(control, F.lit(0))), method))
    out = groups.withColumn("__d", F.when(F.size(control) > 0, total).otherwise(0.0))
    if name == "__all":
        return out.select(*keys, F.col("__d").alias(name))
    whole = groups.groupBy("feature").agg(F.sum("size").alias("__size"))
    # As many rows as there are features. A null bin has no part but stays in the size.
    return out.join(F.broadcast(whole), "feature").select(*keys, F.when(F.col("bin").isNull(), 0.0).otherwise(F.col("__d") * F.col("size") / F.col("__size")).alias(name))


def divergence_filter(df: DataFrame, e: Experiment, features: list[str], bins: int = 10, method: str = "KL", smooth: bool = True) -> DataFrame:
    """feature, score: the binned divergence less that of all rows, highest first."""
    found = divergence_bins(df, e, features, bins, method, smooth)
    whole = df.where(F.col(e.outcome).isNotNull() & F.col(e.treatment).isNotNull()).groupBy(_arm(e).alias("t"), F.col(e.outcome).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    overall = _divergences(whole.withColumn("g", F.lit(0)), e, method, smooth, ["g"], "__all").select("__all")
    base = overall.first()
    return found.groupBy("feature").agg((F.sum("contribution") - F.lit(base[0] if base else None)).alias("score")).orderBy(F.desc("score"), "feature")


def uplift_curve_bins(df: DataFrame, e: Experiment, features: list[str], bins: int = 10) -> DataFrame:
    """feature, bin, contribution: the bin's effect times its share of the rows; an empty arm's rate counts 0."""
    found = cells(discretise(df, features, bins), e, features)
    t, c, y = F.col("t") == TREATED, F.col("t") == CONTROL, F.col("y") == 1
    n = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    by = found.groupBy("feature", "bin").agg(n(t).alias("nt"), n(c).alias("nc"), n(t & y).alias("rt"), n(c & y).alias("rc"), F.sum("n").alias("__n"))
    whole = by.groupBy("feature").agg(F.sum("__n").alias("__size"))
    effect = F.coalesce(F.try_divide(F.col("rt"), F.col("nt")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("rc"), F.col("nc")), F.lit(0.0))
    # As many rows as there are features.
    return by.join(F.broadcast(whole), "feature").select("feature", "bin", F.when(F.col("bin").isNotNull(), effect * (F.col("nt") + F.col("nc")) / F.col("__size")).otherwise(0.0).alias("contribution"))


def uplift_curve_filter(df: DataFrame, e: Experiment, features: list[str], bins: int = 10) -> DataFrame:
    """feature, score: the sum of the bins' contributions, with its sign, highest first."""
    return uplift_curve_bins(df, e, features, bins).groupBy("feature").agg(F.sum("contribution").alias("score")).orderBy(F.desc("score"), "feature")


def niv_bins(df: DataFrame, e: Experiment, features: list[str], bins: int = 10) -> DataFrame:
    """feature, bin, contribution: the bin's net weight of evidence times its net share of responses."""
    found = cells(discretise(df, features, bins), e, features)
    arm = {1: F.col("t") == TREATED, 0: F.col("t") == CONTROL}
    cell = {(r, t): arm[t] & (F.col("y") == r) for r in (0, 1) for t in (0, 1)}
    by = found.groupBy("feature", "bin").agg(*[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(f"n{r}{t}") for (r, t), x in cell.items()])
    totals = by.groupBy("feature").agg(*[F.sum(f"n{r}{t}").alias(f"s{r}{t}") for r, t in cell])
    share = {k: F.coalesce(F.try_divide(F.col(f"n{k[0]}{k[1]}"), F.col(f"s{k[0]}{k[1]}")), F.lit(0.0)) for k in cell}

    def evidence(t: int) -> Column:
        one, zero = share[1, t], share[0, t]
        return F.when(zero == 0, -NO_EVIDENCE).when(one == 0, NO_EVIDENCE).otherwise(F.log10(F.try_divide(one, zero)))

    value = (evidence(1) - evidence(0)) * (share[1, 1] * share[0, 0] - share[0, 1] * share[1, 0])
    return by.join(F.broadcast(totals), "feature").where("bin is not null").select("feature", "bin", value.alias("contribution"))


def niv_filter(df: DataFrame, e: Experiment, features: list[str], bins: int = 10) -> DataFrame:
    """feature, score: the mean of the bins' contributions, highest first."""
    return niv_bins(df, e, features, bins).groupBy("feature").agg((F.sum("contribution") / F.count(F.lit(1))).alias("score")).orderBy(F.desc("score"), "feature")


def date_range(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Rows whose date or fold lies between the bounds, both included."""
    return df.where(F.col(column).between(low, high))


def linear_weighting(scores: DataFrame, columns: list[str], name: str = "weighted_score") -> DataFrame:
    """scores with the columns' sum weighted i / n for the i-th (later ones count more), highest first."""
    n = len(columns)
    return scores.withColumn(name, reduce(add, [F.col(c) * F.lit((i + 1) / n) for i, c in enumerate(columns)])).orderBy(F.desc(name))


def min_max(scores: DataFrame, columns: list[str]) -> DataFrame:
    """The columns scaled to [0, 1]; null where all values are equal. The bounds are one row."""
    row = scores.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    return scores.select(*[F.try_divide(F.col(c) - F.lit(row[f"a{i}"]), F.lit(row[f"b{i}"]) - F.lit(row[f"a{i}"])).alias(c) for i, c in enumerate(columns)])

"""A randomised trial with known effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaplane.functions.draws import fast_uniform, normal


def randomised_trial(spark: SparkSession, rows: int = 1000, features: int = 5, noise: float = 1.0, binary: bool = False, cost_benefit: bool = False, seed: int = 0) -> DataFrame:
    """unit, treatment, outcome, propensity, expected_outcome, actual_cate, feature_1..n [, benefit, cost].

    Features are standard normal; the base outcome is max(0, x1 + x2 + x3) + max(0, x4 + x5), the effect
    x1 + log(1 + exp(x2)), half of it added for the treated and half taken from the others. Binary outcomes are the
    sign of the potential outcome, and the effect the difference of their logistic values. Every number is a hash of
    seed, column and unit, so the rows are the same on any partitioning.
    """
    if features < 5:
        raise ValueError("the base outcome needs 5 features")
    x = [F.col(f"feature_{i + 1}") for i in range(features)]
    uniform_ = lambda name: fast_uniform(seed, F.lit(name), F.col("unit")).alias(f"__{name}")
    normal_ = lambda name, to: normal(seed, F.lit(name), F.col("unit")).alias(to)
    df = spark.range(rows).withColumnRenamed("id", "unit").select("unit", *[normal_(f"x{i + 1}", f"feature_{i + 1}") for i in range(features)], uniform_("w"), normal_("e1", "__e1"), normal_("e0", "__e0"), *[uniform_(f"u{k}") for k in range(3)])
    base = F.greatest(F.lit(0.0), x[0] + x[1] + x[2]) + F.greatest(F.lit(0.0), x[3] + x[4])
    effect = x[0] + F.log1p(F.exp(x[1]))
    treated = F.col("__w") < 0.5
    y1, y0 = base + effect / 2 + noise * F.col("__e1"), base - effect / 2 + noise * F.col("__e0")
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    outcome: Column = F.when(treated, y1).otherwise(y0)
    if binary:
        outcome, effect = F.when(outcome > 0, 1).otherwise(0), sigmoid(y1) - sigmoid(y0)
    out = df.select("unit", F.when(treated, 1).otherwise(0).alias("treatment"), outcome.alias("outcome"), F.lit(0.5).alias("propensity"), base.alias("expected_outcome"), effect.alias("actual_cate"), *x, "__u0", "__u1", "__u2")
    if cost_benefit:
        gamma = -F.log(F.greatest(F.col("__u0") * F.col("__u1") * F.col("__u2"), F.lit(1e-300)))
        out = out.withColumn("benefit", F.when(F.col("outcome") == 0, 0.0).otherwise(gamma)).withColumn("cost", F.when(F.col("treatment") == 0, 0.0).otherwise(F.col("benefit") / 4))
    return out.drop("__u0", "__u1", "__u2")

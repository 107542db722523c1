"""A running treatment effect over a stream of units: the statistics are sums, so windows of event time suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaplane.operators.evaluate import _terms, ratios
from deltaplane.operators.roles import Experiment


def effect_by_window(stream: DataFrame, e: Experiment, time: str, window: str = "1 hour", late: str = "10 minutes", by_bucket: bool = False) -> DataFrame:
    """start, end, [bucket,] n, ate and both target rates of each window; rows later than `late` are left out.

    Works on a streaming or a stored frame. State is bounded by windows x buckets.
    """
    terms = {k: v for k, v in _terms(e.with_(benefit=e.outcome, cost=e.outcome), F.lit(1)).items() if k in ("n", "n_t", "n_c", "y_t", "y_c")}
    keys = [F.window(time, window).alias("w"), *([F.col(e.bucket).alias("bucket")] if by_bucket else [])]
    sums = stream.withWatermark(time, late).groupBy(*keys).agg(*[v.alias(f"__{k}") for k, v in terms.items()])
    return sums.select("w.start", "w.end", *(["bucket"] if by_bucket else []), F.col("__n").alias("n"), *[c.alias(n) for n, c in ratios("ate").items()])

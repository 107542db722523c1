"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaplane.llm._shared import join_shuffled, materialise


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b: long) -> (node, root): root is the smallest node of the component.

    Alternating large-star and small-star steps; each is an aggregate (with map-side partial sums, so a hub costs one
    row for each task) and a shuffle join that the optimiser may split, never a broadcast. Every round is written to the shared folder; links and
    labels never reach the driver, which only sees a row count and a checksum.
    """
    edges = materialise(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = join_shuffled(both, least, ["a"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_shuffled(large, least, ["a"]).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        edges = materialise(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

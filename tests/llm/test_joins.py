"""No join sends a table to the driver because Spark guesses that it is small."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from deltaplane.llm import _components, _shared, simhash, substring


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that the operator stores."""
    seen, stored = [], _components.materialise

    def spy(df, name):
        seen.append(plan_of(df))
        return stored(df, name)

    monkeypatch.setattr(_components, "materialise", spy)
    monkeypatch.setattr(simhash, "materialise", spy)
    monkeypatch.setattr(substring, "materialise", spy)
    return seen


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_broadcast_nothing(spark, plans):
    docs = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o p q r s {k % 3}") for k in range(9)] + [(20, None)], "doc_id bigint, text string")
    out = simhash.near_duplicates(docs)
    plans.append(plan_of(out))
    assert sum("SortMergeJoin" in p for p in plans) > 3 and not any("Broadcast" in p for p in plans)
    assert out.count() == 10


def test_pipeline_joins_by_shuffle(spark, plans):
    """Of the near-duplicates the kept ones, and a table that was counted as too large, meet their rows in a shuffle."""
    docs = spark.createDataFrame([(k, f"a b c d e f g h {k}") for k in range(4)], "doc_id bigint, text string")
    assert "Broadcast" not in plan_of(simhash.keep_one(docs))
    small = spark.range(5).withColumnRenamed("id", "doc_id")
    assert "Broadcast" not in plan_of(_shared.join_checked(docs, small, ["doc_id"], most=4))
    assert "Broadcast" in plan_of(_shared.join_checked(docs, small, ["doc_id"], most=5))


def test_texts_meet_requests_by_shuffle(spark, plans):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(69)), lambda k: F.concat(F.lit("w"), F.when(k % 23 == 20, k * 100 + F.col("id")).otherwise(k).cast("string"))))
    found = substring.shared_passages(spark.range(1, 3).select(F.col("id").alias("doc_id"), text.alias("text"))).collect()
    assert [(r["doc_id"], r["other_id"]) for r in found] == [(2, 1)]
    met = [p for p in plans if "collect_list" in p]
    assert met and all(re.search(r"SortMergeJoin\S* \[own#\w+\], \[doc_id#", p) for p in met)

"""Experiments in the sample tables, as frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaplane.operators.roles import Experiment

#: Orders joined to customers: unit o_orderkey.
ORDERS = """
SELECT o_orderkey AS unit, CAST(o_orderkey % 2 AS INT) AS treatment, CAST(o_orderkey % 3 AS INT) AS arm,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome, c_acctbal AS score, c_mktsegment AS bucket,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END AS benefit,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(0.05 AS DOUBLE) * o_totalprice ELSE CAST(0 AS DOUBLE) END AS cost,
  o_totalprice, o_orderdate
FROM orders JOIN customer ON o_custkey = c_custkey"""
#: Line items: order, part, supplier and line number tell them apart.
LINES = """
SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS treatment, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS outcome,
  l_extendedprice AS score, CAST(l_linenumber AS DOUBLE) AS bucket, l_extendedprice * (1 - l_discount) AS benefit,
  l_extendedprice * l_tax AS cost, l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_extendedprice,
  l_orderkey, l_partkey, l_suppkey
FROM lineitem"""
#: Events: unit event_id.
EVENTS = """
SELECT event_id AS unit, CAST(user_id % 2 AS INT) AS treatment, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS outcome,
  value AS score, CAST(day(ts) AS DOUBLE) AS bucket, value AS benefit,
  CASE WHEN user_id % 2 = 1 THEN CAST(0.1 AS DOUBLE) * value ELSE CAST(0 AS DOUBLE) END AS cost, value
FROM events"""
SQL = {"orders": (ORDERS, ("orders", "customer")), "lines": (LINES, ("lineitem",)), "events": (EVENTS, ("events",))}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The experiment of that name over the tables of a folder."""
    sql, tables = SQL[name]
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)


def experiment(name: str) -> Experiment:
    """Roles of the view's columns."""
    return Experiment(key=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber") if name == "lines" else ("unit",))

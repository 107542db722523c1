"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rules `[^\x20\x09-\x0D]+`, as literal characters.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/deltaplane-shared"
    return f"{root.rstrip('/')}/deltaplane"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions of a keyed shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null and blank texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def running_sums(df: DataFrame, order: list[str], values: list[str], by: list[str] | None = None, name: str = "sums", nulls_last: bool = False) -> DataFrame:
    """Adds `before_<value>`: the sum of value over all rows before, in the order of `by` and then `order`,
    starting anew with each group of `by`. Values are whole and not negative; nulls count as 0.

    The rows are range-sorted and summed within partitions; of the partitions themselves only one total for each
    partition (and for the last group of `by` in it) reaches the driver, so neither rows nor groups are gathered. A
    hot group simply spans several partitions. Rows that tie in `by` and `order` keep an arbitrary but stored order.
    """
    by = by or []
    spark, schema = df.sparkSession, df.schema
    spread = F.xxhash64(*[F.col(c) for c in [*by, *order]])
    sort = [*[F.col(c).asc_nulls_last() for c in by], *[F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c in order], spread]
    ranged = df.repartitionByRange(parts(spark), *sort).sortWithinPartitions(*sort)
    out = T.StructType([*schema.fields, *(T.StructField(f"before_{v}", T.LongType()) for v in values), T.StructField("__part", T.IntegerType()), T.StructField("__group", T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, group, totals = TaskContext.get().partitionId(), None, 0, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if by:
                keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by], strict=True))
                new = np.array([keys[0] != last and last is not None, *(keys[i] != keys[i - 1] for i in range(1, n))])
                last = keys[-1]
            else:
                new = np.zeros(n, bool)
            groups = group + np.cumsum(new)
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            columns = []
            for k, v in enumerate(values):
                x = np.array(batch.column(batch.schema.get_field_index(v)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                sums = np.concatenate([[0], np.cumsum(x)])
                start = np.where(groups == group, -totals[k], sums[first])
                columns.append(pa.array(sums[:-1] - start))
                totals[k] = int(sums[-1] - start[-1])
            group = int(groups[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(np.full(n, part, np.int32)), pa.array(groups.astype(np.int32))], names=[*batch.schema.names, *(f"before_{v}" for v in values), "__part", "__group"])

    done = materialise(ranged.mapInArrow(local, out), name)
    # A row for each partition: its first and last group and the totals of the last.
    edge = [F.struct(F.col("__group"), *[F.col(c) for c in by], *[(F.col(f"before_{v}") + F.coalesce(F.col(v).cast("long"), F.lit(0))).alias(f"total_{v}") for v in values]).alias("e")]
    ends = done.select("__part", *edge).groupBy("__part").agg(F.max(F.struct("e.__group", *[f"e.total_{v}" for v in values])).alias("last"), *[F.max_by(F.col("e")[c], F.col("e.__group")).alias(f"l{i}") for i, c in enumerate(by)], *[F.min_by(F.col("e")[c], F.col("e.__group")).alias(f"f{i}") for i, c in enumerate(by)]).collect()
    carried, carry, key = {}, [0] * len(values), None
    for r in sorted(ends, key=lambda r: r["__part"]):
        first, last = tuple(r[f"f{i}"] for i in range(len(by))), tuple(r[f"l{i}"] for i in range(len(by)))
        carry = carry if key is None or first == key else [0] * len(values)
        carried[r["__part"]] = list(carry)
        own = [r["last"][f"total_{v}"] for v in values]
        carry = [a + b for a, b in zip(carry, own, strict=True)] if r["last"]["__group"] == 0 else own
        key = last
    if not carried:
        return done.drop("__part", "__group")
    table = spark.createDataFrame([(p, *c) for p, c in sorted(carried.items())], ", ".join(["__part int", *(f"__carry_{v} bigint" for v in values)]))
    # One row for each partition: as many as the shuffle has, whatever the input.
    joined = done.join(F.broadcast(table), "__part")
    return joined.select(*[c for c in df.columns], *[(F.col(f"before_{v}") + F.when(F.col("__group") == 0, F.col(f"__carry_{v}")).otherwise(0)).alias(f"before_{v}") for v in values])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of consecutive rows with equal keys, across the batches of a sorted partition."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        for c in columns:
            x = c.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        starts = [0, *np.nonzero(change)[0].tolist(), n]
        for a, b in zip(starts, starts[1:], strict=False):
            own = tuple(c[a].as_py() for c in columns)
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def join_shuffled(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins by a shuffle of both sides, whatever their sizes are guessed to be: a guess ignores what an explode multiplies,
    and a compressed file is far smaller than its rows, so that a broadcast could fill the driver. Both sides are
    shuffled for this join alone, as the optimiser only then splits hot keys. The keys are longs."""
    keys = [f"__key{i}" for i in range(len(on))]
    # The other bits: a side that is partitioned by the columns already, by an aggregate, isn't by these.
    turned = lambda x: x.withColumns({k: F.bitwise_not(F.col(c)) for k, c in zip(keys, on, strict=True)})
    return turned(df).join(turned(other).drop(*on).hint("merge"), keys, how).drop(*keys)


def join_checked(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = 20_000) -> DataFrame:
    """Joins a table that is small as a rule: broadcast only if its counted rows are `most` or fewer, else a shuffle
    join whose hot keys the optimiser splits, whatever the guessed size."""
    return df.join(F.broadcast(small) if small.count() <= most else small.hint("merge"), on, how)

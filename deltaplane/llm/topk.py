"""Exact top-k inner products by an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaplane.llm._shared import materialise

#: Values of a segment share their value divided by this.
STEP = 16
#: Segments are taken in so many rounds; the stop is tested after each.
ROUNDS = 8
#: Sums below this are exact in doubles too, in which bounds are kept; beyond it Python's whole numbers are used.
EXACT = 1 << 52
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the components floor(256 * x) as doubles, which hold them exactly; without rows whose id, vector or a
    component is null or not finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(F.forall(vector, good), F.lit(False)) & F.col(vec_id).isNotNull()
    # Beyond 2^53 doubles are whole, and 256 times them is as exact; Spark's floor gives a long, which ends at 2^63.
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(256 * x).cast("double")).otherwise(256 * x)
    return vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: whole(x.cast("double"))).alias("v")).distinct()


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers of doubles that are whole: 64-bit ones, or Python's where they don't fit."""
    if not x.size or np.abs(x).max() < EXACT:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class Shard:
    """Rows of a block and, by dimension, their posting segments: rows of nearby values, from the lowest."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, _whole(values)
        self.most = int(abs(self.values).max()) if values.size else 0
        self.dims = np.zeros(0, np.int64)
        if self.values.dtype == object:
            return  # scored without an index
        values = self.values
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32).T.copy()
        dims, starts, ends, low, high = [], [], [], [], []
        for d in range(values.shape[1]):
            own = values[self.order[d], d]
            cuts = np.concatenate([[0], np.nonzero(np.diff(own // STEP))[0] + 1, [len(own)]]) if len(own) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                dims.append(d)
                starts.append(a)
                ends.append(b)
                low.append(int(own[a]))
                high.append(int(own[b - 1]))
        self.dims, self.starts, self.ends, self.low, self.high = (np.array(x, np.int64) for x in (dims, starts, ends, low, high))
        self.first = np.concatenate([[0], np.nonzero(np.diff(self.dims))[0] + 1])

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows the k ids of highest score, each once; ties go to smaller ids."""
        order = np.lexsort((self.ids[rows], -scores)) if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]])), int)
        ids = self.ids[rows][order]
        _, first = np.unique(ids, return_index=True)
        own = np.sort(first)[:k]
        return ids[own], scores[order][own]

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores, own_id left out; ties go to smaller ids."""
        n, query = len(self.ids), _whole(query)
        wide = self.values.shape[1]
        safe = query.dtype != object and self.values.dtype != object and wide * self.most * (int(abs(query).max()) if query.size else 0) < EXACT
        q = np.zeros(wide, np.int64 if safe else object)
        q[: min(len(q), len(query))] = query[: len(q)] if safe else [int(v) for v in query[: len(q)]]
        exact = (lambda rows: self.values[rows] @ q) if safe else lambda rows: self.values[rows].astype(object) @ q if wide else np.zeros(len(rows), np.int64)
        if not safe or not len(self.dims):  # too large for bounds in 64 bits, or only empty vectors
            rows = np.nonzero(self.ids != own_id)[0]
            return self.best(rows, exact(rows), k)
        upper = np.maximum(q[self.dims] * self.low, q[self.dims] * self.high)
        least = np.minimum.reduceat(upper, self.first)
        impact = upper - least[self.dims]
        order = np.argsort(-impact, kind="stable")
        seen = np.zeros(n, np.float64)
        floor = int(least.sum())
        allowed = self.ids != own_id
        possible = np.nonzero(allowed)[0]
        sizes = np.cumsum((self.ends - self.starts)[order])
        at = 0
        while at < len(order) and len(possible) > max(4 * k, 64):
            done = sizes[at - 1] if at else 0
            to = min(len(order), max(at + 1, int(np.searchsorted(sizes, done + sizes[-1] / ROUNDS))))
            own = order[at:to]
            own = own[impact[own] > 0]
            if len(own):
                rows = np.concatenate([self.order[d, a:b] for d, a, b in zip(self.dims[own].tolist(), self.starts[own].tolist(), self.ends[own].tolist(), strict=True)])
                seen += np.bincount(rows, weights=np.repeat(impact[own], self.ends[own] - self.starts[own]), minlength=n)
            at = to
            # What the segments still to come can add to any row: the next impact of each dimension.
            rest = np.zeros(len(least), np.int64)
            np.maximum.at(rest, self.dims[order[at:]], impact[order[at:]])
            bound = seen[possible] + floor + int(rest.sum())
            top = possible[np.argpartition(-seen[possible], 2 * k)[: 2 * k]]
            _, sure = self.best(top, exact(top), k)
            if len(sure) == k:  # of k different ids
                possible = possible[bound >= sure[-1]]
        return self.best(possible, exact(possible), k)


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Stored rows(block, n, dims, ids, v): a block for each partition, of about `size` vectors; and how many."""
    many = max(1, -(-rows.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, values = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            values += b.column(1).to_pylist()
        dims = max(map(len, values), default=0)
        matrix = np.zeros((len(values), dims), "<f8")
        for i, v in enumerate(values):
            matrix[i, : len(v)] = v
        yield pa.RecordBatch.from_pylist([{"block": TaskContext.get().partitionId(), "n": len(ids), "dims": dims, "ids": np.array(ids, "<i8").tobytes(), "v": matrix.tobytes()}])

    return materialise(rows.repartition(many).mapInArrow(run, "block bigint, n bigint, dims bigint, ids binary, v binary"), name), many


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", shard: int = 4096, block: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every` its k best other rows.

    Candidates stand in shards of bounded size, queries in blocks. A shard is sent once and every block visits it;
    segments are taken in descending impact until the k-th best score found is out of reach for all but a few rows,
    which are scored exactly. Shards hand on k ids for each query; the best of them are the result. A shorter vector
    counts as filled with zeros. Repeated rows count once; several vectors of one id count as one item with its best
    score. Rows that are null or not finite take no part; any finite component does, and scores are exact whole numbers
    (those beyond a long rank exactly within their shard and are shown as the longest). Ties go to smaller ids. Other
    columns are ignored, whatever their names; very long vectors need memory for a shard of them. Empty tables give an
    empty result.
    """
    rows = materialise(quantised(vectors, vec_id, vector), "vectors")
    shards, many = _blocks(rows, shard, "shards")
    queries, _ = _blocks(rows.where(F.pmod("vec_id", F.lit(every)) == 0), block, "queries")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "n", "dims", "ids", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
                ids, values = np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["v"], "<f8").reshape(x["n"], x["dims"])
                if not x["kind"]:
                    held = Shard(ids, values) if x["n"] else None
                elif held and x["n"]:
                    out = [(q, *held.search(q, values[r], k)) for r, q in enumerate(ids.tolist())]
                    scores = [max(-LONG, min(LONG, int(v))) for _, _, s in out for v in s]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in out]), pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    both = shards.select("block", F.lit(0).alias("kind"), "n", "dims", "ids", "v").union(asked)
    met = both.repartitionById(many, F.col("block").cast("int")).sortWithinPartitions("block", "kind")
    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

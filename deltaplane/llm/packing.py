"""Packing token sequences into windows: best-fit decreasing over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaplane.llm._encode import encoder, text_batches
from deltaplane.llm._shared import join_checked, materialise


class OpenWindows:
    """Runs of open windows (first sequence, how many) by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i //= 2

    def put(self, room: int, first: int, many: int) -> None:
        if room and many:
            self.runs[room].append((first, many))
            self._count(room, 1)

    def tightest(self, length: int) -> int:
        """The smallest capacity of `length` or more that an open window has; 0 if none has."""
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return 0

    def pop(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.runs[room].pop()


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """How best-fit decreasing places counts[length] pieces: runs (length, from, to, sequence, per_window, offset).

    Piece `from + t` of its length goes to sequence + t // per_window at offset + (t % per_window) * length. Equal
    pieces are placed together: the window that got one is the tightest for the next while it has room, so the result
    is that of placing them one by one, and the work depends on the lengths, not on the number of pieces.
    """
    windows, placed, sequences = OpenWindows(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = windows.tightest(length)
            if room:
                first, many = windows.pop(room)
            else:
                room, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            each = room // length
            used = min(many, -(-left // each))
            items = min(left, used * each)
            placed.append((length, done, done + items, first, each, capacity - room))
            last = items - (used - 1) * each
            windows.put(room, first + used, many - used)
            windows.put(room - each * length, first, used - 1)
            windows.put(room - last * length, first + used - 1, 1)
            done += items
            left -= items
    return placed


def tokenised(docs: DataFrame, tokenizer: str, end: int = 0, window: int = 1024) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, start, length, doc_tokens, ids (unsigned 32-bit, little-endian), part, nth.

    Documents are cut into full windows and a rest. nth numbers the pieces of a length within their input partition.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length int, doc_tokens bigint, ids binary, part int, nth bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, coder = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), encoder(tokenizer)
        for b in text_batches(batches, "text"):
            flat, counts = coder.encode(b.column(b.schema.get_field_index("text")))
            ends = np.cumsum(counts)
            row, start, length, nth, ids = [], [], [], [], []
            for i, (to, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                own = np.append(flat[to - n : to], np.uint32(end)).astype("<u4")
                for at in range(0, n + 1, window):
                    piece = own[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    nth.append(int(seen[len(piece)]))
                    ids.append(piece.tobytes())
                    seen[len(piece)] += 1
            doc = b.column(b.schema.get_field_index("doc_id")).take(pa.array(row))
            total = (counts + 1)[np.array(row, np.int64)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth, pa.int64())], names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"])

    return docs.mapInArrow(run, schema)


def place(pieces: DataFrame, narrow: DataFrame | None = None, window: int = 1024) -> DataFrame:
    """pieces (of tokenised(), stored) with sequence_id and offset instead of part and nth. narrow: pieces with the
    columns that shall be kept."""
    spark = pieces.sparkSession
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(total, window)
    # As many rows as there are pairs of partitions and lengths.
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    out = join_checked(narrow if narrow is not None else pieces, before, ["part", "length"], most=(8 << 20) // 32)  # rows of a key, a sum and their headers
    # The plan's size is bound by the window length, not by the corpus.
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "length int, first bigint, last bigint, sequence bigint, per_window bigint, shift bigint")
    rank = F.col("before") + F.col("nth")
    out = out.withColumn("rank", rank).join(F.broadcast(table), "length").where("rank >= first and rank < last")
    t = F.col("rank") - F.col("first")
    placed = out.withColumn("sequence_id", F.col("sequence") + F.floor(t / F.col("per_window")).cast("long")).withColumn("offset", F.col("shift") + F.pmod(t, F.col("per_window")) * F.col("length"))
    return placed.withColumn("length", F.col("length").cast("long")).drop("part", "nth", "before", "rank", "first", "last", "sequence", "per_window", "shift")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0, window: int = 1024) -> DataFrame:
    """A row for each piece: length, doc_id, start, doc_tokens, ids, sequence_id, offset.

    Every id of every document, with the end id, lies in one piece; the pieces of a sequence lie one behind another
    from offset 0. Null and empty texts are a single end id, texts of any length are cut into windows. Repeated rows are
    packed each; pieces of one length have their places in the order of the stored parts. An empty table gives an empty
    result; other columns are ignored, whatever their names. Best-fit decreasing runs on the counts of lengths (at most `window` numbers reach the driver), pieces
    get their places by their rank among those of their length.
    """
    return place(stored(docs, tokenizer, doc_id, text, end, window), window=window)


def stored(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0, window: int = 1024) -> DataFrame:
    """The pieces of docs, in the shared folder."""
    return materialise(tokenised(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), tokenizer, end, window), "pieces")

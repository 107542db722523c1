"""Token ids in wavelet-matrix files, one for each shard: access, counting and occurrence lookup by rank and select."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaplane.llm._encode import encoder, text_batches
from deltaplane.llm._shared import materialise, parts

MAGIC = b"WVM1"
#: Bits between two stored ranks.
BLOCK = 512


class WaveletMatrix:
    """Bit planes from the highest bit down; each plane's rows are those of the plane above, zeros first.

    Layout: magic, planes (u1, padded to 4), tokens (u8), zeros of each plane (u8 each), then for each plane its bits
    (u1 each 8, little-endian, whole blocks) and the ranks at block starts (u4 each).
    """

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.bits, self.n = struct.unpack_from("<BxxxQ", data, 4)
        self.zeros = np.frombuffer(data, "<u8", self.bits, 16).astype(np.int64)
        blocks, at = -(-self.n // BLOCK), 16 + 8 * self.bits
        self.planes, self.ranks = [], []
        for _ in range(self.bits):
            self.planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
            self.ranks.append(np.frombuffer(data, "<u4", blocks, at))
            at += 4 * blocks

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> bytes:
        n = len(ids)
        blocks = -(-n // BLOCK)
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, body = [], []
        for b in range(bits - 1, -1, -1):
            one = (a >> b & 1).astype(bool)
            packed = np.zeros(blocks * BLOCK // 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(one, bitorder="little")
            ones = np.bitwise_count(packed.view("<u8")).reshape(blocks, -1).sum(1, dtype=np.int64) if blocks else np.zeros(0, np.int64)
            body += [packed.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            low, high = a[~one], a[one]
            zeros.append(len(low))
            a = np.concatenate([low, high])
        return MAGIC + struct.pack("<BxxxQ", bits, n) + np.array(zeros, "<u8").tobytes() + b"".join(body)

    def _rank(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        k, own = i // BLOCK, self.planes[plane]
        whole, rest = own[k * BLOCK // 8 : i // 8], i % 8
        return int(self.ranks[plane][k]) + int(np.bitwise_count(whole).sum()) + (int(own[i // 8] & ((1 << rest) - 1)).bit_count() if rest else 0)

    def _select(self, plane: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) one or zero of a plane, by the ranks of blocks and then within a block."""
        ranks = self.ranks[plane]
        before = lambda b: int(ranks[b]) if one else b * BLOCK - int(ranks[b])
        block, behind = 0, len(ranks)
        while behind - block > 1:
            middle = (block + behind) // 2
            block, behind = (middle, behind) if before(middle) <= k else (block, middle)
        own = np.unpackbits(self.planes[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.nonzero(own == one)[0][k - before(block)])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for p in range(self.bits):
            one, r = int(self.planes[p][i // 8] >> (i % 8) & 1), self._rank(p, i)
            value, i = value * 2 + one, int(self.zeros[p]) + r if one else i - r
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for p in range(self.bits):
            ra, rb = self._rank(p, a), self._rank(p, b)
            a, b = (int(self.zeros[p]) + ra, int(self.zeros[p]) + rb) if token >> (self.bits - 1 - p) & 1 else (a - ra, b - rb)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often the id stands in positions a to b."""
        if token >> self.bits:
            return 0
        x, y = self._range(token, a, self.n if b is None else b)
        return y - x

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id, -1 if there are fewer."""
        if token >> self.bits:
            return -1
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for p in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - p) & 1)
            i = self._select(p, i - int(self.zeros[p]) if one else i, one)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes' partitions undone from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(values)
            zeros = int(self.zeros[p])
            above[~one], above[one] = values[:zeros], values[zeros:]
            values = above | (one.astype(values.dtype) << np.array(self.bits - 1 - p, values.dtype))
        return values.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, bits: int = 16, shard_tokens: int = 1 << 19) -> DataFrame:
    """Writes the ids of docs in ascending doc_id order and returns the stored shards.

    A row is a shard: part, shard (their order), before (ids of the part before it), doc_ids, counts and file, the
    wavelet matrix of its ids. A shard ends with the document that fills it, so a very long document makes a long one.
    Null doc_ids come first; null texts are empty: the end id alone. Rows that share a doc_id are documents of their own,
    in the order of their texts; other columns are ignored, whatever their names; an empty table gives no shards. The container is Parquet, compressed, in the
    shared folder, since executors can only write there through Spark.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", "text"]
    ranged = narrow.repartitionByRange(parts(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, shard, before = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        docs_held, counts_held, ids_held, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(ids_held)
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"an id does not fit in {bits} bits")
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "before": before, "n": held, "doc_ids": docs_held, "counts": counts_held, "file": WaveletMatrix.build(ids, bits)}], schema)

        schema = None
        for b in text_batches(batches, "text", 1 << 21):
            column = b.column(b.schema.get_field_index("doc_id"))
            schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(column.type)), ("counts", pa.list_(pa.int64())), ("file", pa.binary())])
            flat, counts = coder.encode(b.column(b.schema.get_field_index("text")))
            ends = np.cumsum(counts)
            ids = np.insert(flat, ends, np.uint32(end))
            bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            own, at = column.to_pylist(), 0
            while at < b.num_rows:
                to = min(b.num_rows, max(at + 1, int(np.searchsorted(bounds, bounds[at] + shard_tokens - held))))
                docs_held += own[at:to]
                counts_held += (counts[at:to] + 1).tolist()
                ids_held.append(ids[bounds[at] : bounds[to]])
                held += int(bounds[to] - bounds[at])
                at = to
                if held >= shard_tokens:
                    yield row()
                    shard, before = shard + 1, before + held
                    docs_held, counts_held, ids_held, held = [], [], [], 0
        if held:
            yield row()

    return materialise(ranged.mapInArrow(run, f"part int, shard int, before bigint, n bigint, doc_ids array<{kind}>, counts array<bigint>, file binary"), "wavelet")


def _before(shards: DataFrame) -> dict[int, int]:
    """Ids of all parts before each part of the write; one total for each part reaches the driver."""
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    sums, carry = {}, 0
    for p in sorted(totals):
        sums[p], carry = carry, carry + totals[p]
    return sums


def _each_shard(shards: DataFrame, find: Callable[[WaveletMatrix, int, np.ndarray], Iterator[dict]], kinds: str) -> DataFrame:
    """The rows that find(matrix, ids before the shard, counts) yields for each shard, with the index of a document
    (`nth`, left out) turned into its doc_id."""
    sums = _before(shards)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(i)[r] for i, c in enumerate(b.schema.names)}
                rows = list(find(WaveletMatrix(x["file"].as_py()), sums[x["part"].as_py()] + x["before"].as_py(), np.array(x["counts"].as_py(), np.int64)))
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    names = [c for c in part[0] if c != "nth"]
                    ids = x["doc_ids"].values.take(pa.array([t["nth"] for t in part]))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([t[c] for t in part], pa.int64()) for c in names]], names=["doc_id", *names])

    return shards.select("part", "before", "doc_ids", "counts", "file").mapInArrow(run, f"doc_id {kind}, {kinds}")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Where stored shards hold the id: doc_id, position (from 0, over all documents) and place (in the document), by
    count and select in each shard's file; nothing is decoded."""

    def find(matrix: WaveletMatrix, before: int, counts: np.ndarray) -> Iterator[dict]:
        ends = np.cumsum(counts)
        for k in range(matrix.count(token)):
            i = matrix.find(token, k)
            nth = int(np.searchsorted(ends, i, "right"))
            yield {"nth": nth, "position": before + i, "place": i - int(ends[nth] - counts[nth])}

    return _each_shard(shards, find, "position bigint, place bigint")


def count_by_document(shards: DataFrame, token: int) -> DataFrame:
    """doc_id and n, how often it holds the id, of the documents of stored shards that hold it."""

    def find(matrix: WaveletMatrix, before: int, counts: np.ndarray) -> Iterator[dict]:
        if not matrix.count(token):
            return
        ends = np.cumsum(counts).tolist()
        for nth, (end, size) in enumerate(zip(ends, counts.tolist(), strict=True)):
            n = matrix.count(token, end - size, end)
            if n:
                yield {"nth": nth, "n": n}

    return _each_shard(shards, find, "n bigint")


def tokens_at(shards: DataFrame, positions: list[int]) -> DataFrame:
    """doc_id, position and token of given positions over all documents, by access in the shards that hold them."""
    wanted = sorted(set(positions))

    def find(matrix: WaveletMatrix, before: int, counts: np.ndarray) -> Iterator[dict]:
        ends = np.cumsum(counts)
        for p in wanted[bisect.bisect_left(wanted, before) : bisect.bisect_left(wanted, before + matrix.n)]:
            yield {"nth": int(np.searchsorted(ends, p - before, "right")), "position": p, "token": matrix.access(p - before)}

    return _each_shard(shards, find, "position bigint, token bigint")


def read_documents(shards: DataFrame) -> DataFrame:
    """Stored shards -> a row for each document: doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    sums = _before(shards)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(i)[r] for i, c in enumerate(b.schema.names)}
                ids = WaveletMatrix(x["file"].as_py()).decode().astype("<u4")
                counts = np.array(x["counts"].as_py(), np.int64)
                ends = np.cumsum(counts)
                starts = sums[x["part"].as_py()] + x["before"].as_py() + ends - counts
                offsets = np.concatenate([[0], ends])
                for k in range(0, len(counts), 4096):
                    to = min(len(counts), k + 4096)
                    own = [ids[offsets[i] : offsets[i + 1]].tobytes() for i in range(k, to)]
                    yield pa.RecordBatch.from_arrays([x["doc_ids"].values[k:to], pa.array(starts[k:to]), pa.array(counts[k:to]), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.select("part", "before", "doc_ids", "counts", "file").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")

"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaplane.llm._components import connected_components
from deltaplane.llm._shared import join_shuffled, materialise, parts, sorted_groups

BITS = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bits lie outside at least one of them.

    Each bit gets a nonzero vector of radius+1 bits; mask v holds the bits whose vector has an odd product with v.
    The vectors of `radius` bits span at most radius dimensions, so some v is orthogonal to all of them.
    """
    state, vectors = np.random.RandomState(seed), []
    while len(vectors) < BITS:  # every nonzero vector equally often, in random order
        vectors += state.permutation(np.arange(1, 1 << (radius + 1))).tolist()
    return [sum(1 << i for i in range(BITS) if bin(vectors[i] & v).count("1") & 1) for v in range(1, 1 << (radius + 1))]


def fingerprint(text: str | None, width: int = 4, seed: int = 42, block: int = 1 << 18) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - width], ends[width - 1 :]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), block):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : k + block].tolist(), ends[k : k + block].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(starts)).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """docs with `fingerprint_bits` (the 64 bits as a long); text is read from the column of that name and kept out."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(f for f in docs.schema if f.name != text), T.StructField("fingerprint_bits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [_signed(fingerprint(x.as_py(), width, seed)) for x in b.column(b.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(bits, pa.int64())], names=[*kept, "fingerprint_bits"])

    return docs.mapInArrow(run, schema)


def forest_links(values: np.ndarray, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links among the values: at most len(values) - 1 of them."""
    n = len(values)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for a in range(0, n, block):
        left = values[a : a + block]
        for b in range(a, n, block):
            near = np.bitwise_count(left[:, None] ^ values[None, b : b + block]) <= radius
            for i, j in zip(*np.nonzero(near), strict=True):
                i, j = int(i) + a, int(j) + b
                if i < j and (x := find(i)) != (y := find(j)):
                    parent[max(x, y)] = min(x, y)
                    found.append((i, j))
    return found


def near_links(prints: DataFrame, radius: int = 4, tile: int = 1024, seed: int = 7) -> DataFrame:
    """prints(f: distinct longs) -> links(a, b) whose components are those of all pairs within the radius.

    A table for each covering mask; a bucket holds the prints equal under the mask. Buckets above `tile` prints are cut
    into tiles, and each pair of tiles is a group of its own, so no task ever holds a whole hot bucket; a group gives a
    spanning forest of its links, not all pairs. Buckets meet their sizes in a shuffle join, as there are as many
    rows as masks for each print, which Spark's guess for a broadcast ignores.
    """
    masks = covering_masks(radius, seed)
    rows = prints.select("f", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("f", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("g", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    h = F.pmod(F.xxhash64("f", "t"), F.col("g").cast("long")).cast("int")
    met = rows.join(sizes.hint("merge"), ["t", "k"]).withColumn("h", h).select("f", "t", "k", "h", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    met = met.select("f", "t", "k", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"))
    keys = ["t", "k", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, group in sorted_groups(batches, keys):
            f = group.column("f").to_numpy()
            for i, j in forest_links(f.view(np.uint64), radius):
                a.append(f[i])
                b.append(f[j])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.repartition(parts(prints.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint_bits, component_id (the smallest doc_id reachable by links).

    Two documents link if their fingerprints differ in `radius` bits or fewer. Null and blank texts have fingerprint 0
    and link like any other. Rows with a null doc_id get the smallest doc_id of their component that isn't null, null
    if there is none. Repeated rows are each returned. An empty table gives an empty result; other columns of docs are
    ignored. Words and shingles of the whole text count, whatever its length.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialise(with_fingerprints(narrow, width=width, seed=seed), "prints")
    least = materialise(prints.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("own")), "distinct-prints")
    links = near_links(least.select(F.col("fingerprint_bits").alias("f")), radius)
    nodes = connected_components(links)
    linked = least.join(nodes.hint("merge"), F.col("fingerprint_bits") == F.col("node"))
    roots = linked.groupBy("root").agg(F.min("own").alias("least"))
    label = join_shuffled(nodes, roots, ["root"]).select("node", "least")
    each = least.join(label.hint("merge"), F.col("fingerprint_bits") == F.col("node"), "left").select("fingerprint_bits", F.coalesce("least", "own").alias("component_id"))
    # Stored, so that no other join shares the stage and hot fingerprints can be split.
    return prints.join(materialise(each, "classes").hint("merge"), "fingerprint_bits").select("doc_id", "fingerprint_bits", "component_id")


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest doc_id stays.

    Rows with a null doc_id stay; of repeated rows with the surviving doc_id one stays.
    """
    classes = near_duplicates(docs, **options)
    survivors = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    kept = docs.join(survivors.hint("merge"), docs["doc_id"] == F.col("__keep"), "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))

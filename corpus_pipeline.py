"""A corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing. Counts as part of the llm subpackage.

Each stage takes all rows of the one before and reads doc_id, text and source; other columns, whatever their names,
travel along to the last stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaplane.llm import mixing, packing, quality, simhash, substring
from deltaplane.llm._shared import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go.

    Each row is judged by its own text, so rows that share a doc_id, or have none, are judged one by one. Null, empty
    and very short texts fail; a null source has no host verdict. Very long texts are measured whole.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash the smallest doc_id stays.

    Rows with a null doc_id stay; of repeated rows with the surviving doc_id one stays. Null and blank texts are alike.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents of which nothing is left go.

    Rows with a null doc_id or text are left as they are; rows that share a doc_id count as one document. Of documents
    that share a passage the smallest doc_id keeps it.
    """
    return substring.without_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document that the mix takes, in training order.

    A null source is one of its own; null and blank texts have no words, so that they are never taken. Ties in the order
    of a source are settled by doc_id, size and the hash of the text.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each row of the mix is packed, so a document that is taken twice has its pieces twice. A null text is its end id.
    """
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixture), ("packing", pack)]

#: Fingerprints, alignment and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again. Returns the packed pieces, the
    ids as their crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")

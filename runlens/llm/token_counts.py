"""Token counts of documents with a cache that is keyed by digests.

The cache is a table of ``content`` (digest of the normalised text), ``tokenizer`` (digest
of the tokenizer file and the library's version) and ``n_tokens``. Texts whose digest the
cache lacks are encoded once each, however many documents share them, and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import written
from runlens.operators.joins import split_lookup

# Rows of one text that meet in one task when counts are looked up; the rows are digests.
COPIES = 1_000

CACHE = "content binary, tokenizer string, n_tokens long"


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def version(model: str) -> str:
    """Digest of the model file and the library's version."""
    import sentencepiece

    with open(model, "rb") as file:
        content = file.read()
    return hashlib.sha256(content + sentencepiece.__version__.encode()).hexdigest()


def normalised(text: F.Column, model: str) -> F.Column:
    """The text as far as the model tells texts apart.

    A model with an identity normalizer that keeps all white space, as the built-in choice
    of this operator, tells all texts apart. Others would need their rules here; until
    then every difference counts, which costs hits and never a wrong count.
    """
    return text


def counted(misses: DataFrame, model: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = processor(model).encode
        for batch in batches:
            sizes = [len(encode(text.as_py(), num_threads=1)) for text in batch.column("text")]
            yield pa.record_batch([batch.column("content"), pa.array(sizes, pa.int64())], names=["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(count, "content binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(cache)


def token_counts(
    docs: DataFrame,
    model: str,
    cache: str,
    limit: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Tokens of each document, and whether there are more than ``limit``.

    ``cache`` is a folder that exists as a cache table or will become one; what is missing
    is appended to it. Null texts are empty. Null ids, repeated ids and repeated rows each
    keep their rows, copies of one text as well, however many. An empty table has no rows.
    Other columns are ignored.
    """
    spark, tokenizer = docs.sparkSession, version(model)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(normalised(content, model), 256))
    known = read_cache(spark, cache).filter(F.col("tokenizer") == tokenizer).dropDuplicates(["content"])
    wanted = docs.select(digest.alias("content"), content.alias("text"))
    # One text per digest. Copies are dropped before the shuffle, inside each input partition.
    misses = wanted.join(known.select("content"), "content", "left_anti").dropDuplicates(["content"])
    new = counted(misses, model).select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens")
    new.write.mode("append").option("compression", "zstd").parquet(cache)
    # The place in the table spreads the copies of a text that holds many rows over several tasks.
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.octet_length(content).cast("long").alias("n_bytes"),
            digest.alias("content"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "digests",
    )
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == tokenizer).dropDuplicates(["content"])
    looked_up = split_lookup(rows, counts.select("content", "n_tokens"), ["content"], "place", part_rows=COPIES)
    return looked_up.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )

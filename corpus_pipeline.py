"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept, as a written table, and returns
documents with the same columns; the last one returns pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontamination, jaccard_join, packing, quality_rules, suffix_dedup
from runlens.llm.common import numbered_rows, small, spare_name, written
from runlens.llm.queries import table, tokenizer, with_shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    key = spare_name(docs, "row_key")
    rows = numbered_rows(docs, key=key)
    found = jaccard_join.near_duplicates(rows, doc_id=key)
    others = written(found.filter("doc_id <> class_id").select(F.col("doc_id").alias(key)), "other-copies")
    return rows.join(small(others), key, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that occur before; emptied documents go.

    Null and empty texts have nothing to lose and stay as they are. A cut never splits a character. ``n_chars``, where there is one, is counted anew.
    """
    key = spare_name(docs, "row_key")
    rows = numbered_rows(docs, key=key)
    kept_text = spare_name(docs, "kept_text")
    kept = suffix_dedup.deduplicated(rows, doc_id=key, with_kept=True, whole_characters=True)
    kept = kept.filter("n_removed < n_bytes OR n_removed = 0").select(
        F.col("doc_id").alias(key), F.col("kept").cast("string").alias(kept_text)
    )
    there = F.col("text").isNotNull()
    joined = rows.join(kept, key)
    if "n_chars" in docs.columns:
        counted = F.length(kept_text).cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(there, counted).otherwise(F.col("n_chars")))
    joined = joined.withColumn("text", F.when(there, F.col(kept_text)))
    return joined.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    key = spare_name(docs, "row_key")
    rows = numbered_rows(docs, key=key)
    found = decontamination.decontaminated(rows, table(spark, sf_dir, "benchmark"), near=0, doc_id=key)
    bad = written(found.filter("contaminated").select(F.col("doc_id").alias(key)), "contaminated")
    return rows.join(small(bad), key, "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    # Workers still hold word hashes of the Jaccard join, so they remember fewer pieces than alone.
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), end_id=1, remembered=300_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("packing", sequences),
]

# Near duplicates by components, byte ranges and token ids are beyond SQL; the tests compare
# the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    with_shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

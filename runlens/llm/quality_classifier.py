"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target texts and one of all texts,
give every document a log importance weight: the sum over its n-grams of the log ratio
of their shares. Gumbel noise, fixed by the document's id, is added, and the top k by the
sum are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import id_of, key_of, mixed, small, word_hashes, written

BUCKETS = 65_536
BIGRAM = np.uint64(0x9E3779B97F4A7C15)
# A bin that holds the k-th row is narrowed until it has at most this many rows.
FEW_ROWS = 10_000


def features(text: str, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text, lower-cased, without edge punctuation."""
    words = [w for w in (w.strip(".,;:!?\"'()[]") for w in text.lower().split()) if w]
    if not words:
        return np.zeros(0, dtype=np.int64)
    one = np.fromiter(map(word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    two = mixed(one[:-1] * BIGRAM + one[1:])
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """Columns ``bucket``, ``raw`` and ``target``: n-grams of all rows and of target rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("target").to_pylist()):
                found = np.bincount(features(text.as_py(), buckets), minlength=buckets)
                raw += found
                if wanted:
                    target += found
        used = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(x) for x in (used, raw[used], target[used])], names=["bucket", "raw", "target"])

    found = rows.mapInArrow(count, "bucket long, raw long, target long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int) -> np.ndarray:
    """Log ratio of target to raw share by bucket.

    Raw counts start at one. Target counts start at the raw shares times the number of
    buckets, so a bucket that the target texts hardly show weighs little either way.
    Collects at most ``buckets`` rows.
    """
    raw, target = np.ones(buckets), np.zeros(buckets)
    for row in counts.collect():
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    raw /= raw.sum()
    return np.log((target + buckets * raw) / (target.sum() + buckets)) - np.log(raw)


def cut_off(rows: DataFrame, k: int) -> tuple[float, int] | None:
    """Key and doc of the k-th row in descending order; null if all rows are within k.

    Counts rows in bins between the least and the greatest key, and narrows the bin that
    holds the k-th row until few rows are left in it.
    """
    least, most, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if n <= k or n == 0:
        return None
    inside, left, bins = rows, k, 1_000
    while n > FEW_ROWS and least < most:
        width = (most - least) / bins
        place = F.least(F.floor((F.col("key") - F.lit(least)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        if width <= 0 or least + width == least:
            break
        counted = inside.groupBy(place).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(counted.collect(), key=lambda r: -r.bin):
            if left <= row.n:
                break
            left -= row.n
        least, most, n = row.low, row.high, row.n
        inside = rows.filter(F.col("key").between(least, most))
    if n <= FEW_ROWS:
        last = inside.orderBy(F.desc("key"), "doc").limit(left).orderBy("key", F.desc("doc")).first()
        return last.key, last.doc
    # One key is shared by very many rows: find the id among them in the same way.
    ties = inside.select((-F.col("doc").cast("double")).alias("key"), F.col("doc"))
    found = cut_off(ties, left)
    return least, found[1] if found else rows.agg(F.max("doc")).first()[0]


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    seed: int = 0,
    buckets: int = BUCKETS,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
) -> DataFrame:
    """One row per document with its log weight, its key, and whether it is in the sample.

    ``labels`` has ``quality`` and ``toxic``; target texts are those with quality 1 and
    toxic 0. ``share`` of all rows are kept, by default the share of target texts among
    the labelled ones. Null texts have no n-grams and weigh 1; null ids keep their rows; rows that share an
    id share their noise and, at equal texts, their verdict. Without labels the weights are all equal.
    """
    good = labels.groupBy(F.col(label_id).cast("long").alias("doc")).agg(
        F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("target")
    )
    good = good.filter("doc IS NOT NULL")
    texts = docs.select(key_of(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    targets = written(good, "labels")
    n_good, n_labelled = targets.agg(F.count_if("target"), F.count("*")).first()
    if share is None:
        share = n_good / n_labelled if n_labelled else 1.0
    rows = texts.join(small(targets), "doc", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    ratios = log_ratios(bucket_counts(rows, buckets), buckets) if n_good else np.zeros(buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [float(ratios[features(text.as_py(), buckets)].sum()) for text in batch.column("text")]
            yield pa.record_batch([batch.column("doc"), pa.array(weights, pa.float64())], names=["doc", "weight"])

    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc")), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    scored = texts.mapInArrow(weigh, "doc long, weight double")
    scored = written(scored.withColumn("key", F.col("weight") - F.log(-F.log(uniform))), "weights")
    last = cut_off(scored, math.ceil(share * scored.count()))
    kept = F.lit(True)
    if last is not None:
        kept = (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (F.col("doc") <= last[1]))
    return scored.select(id_of("doc").alias("doc_id"), "weight", "key", kept.alias("kept"))

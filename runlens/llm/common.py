"""What the operators share: written tables, document keys, word hashes, components."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows without an id sort before all others.
NO_ID = -(2**63)

# Rows up to which a table of ids or totals may be broadcast: 1 M rows of two longs take
# about 32 MB. Beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, which cuts the lineage."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it is known to have few rows.

    ``frame`` has to be cheap to count, such as a written table.
    """
    return F.broadcast(frame) if frame.count() <= rows else frame


def key_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_of(key: str) -> Column:
    """The id that a key stands for."""
    return F.when(F.col(key) != NO_ID, F.col(key))


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc``, ``copy``, ``text`` that name each row once.

    Rows that share an id are told apart by ``copy``, numbered in the order of their
    texts. Ids are usually unique, then ``copy`` is 0 and the texts stay in their scan;
    only otherwise a table with numbered rows is written. Null texts are empty.
    """
    rows = docs.select(key_of(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = rows.groupBy("doc").count().filter("count > 1").limit(1).count()
    if not repeated:
        return rows.select("doc", F.lit(0).alias("copy"), "text")
    rows.createOrReplaceTempView(view := f"rows_{uuid.uuid4().hex}")
    numbered = docs.sparkSession.sql(
        f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY text) - 1 AS copy, text FROM {view}"
    )
    return written(numbered, "numbered")


def spare_name(frame: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as keep it apart from the frame's columns."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def numbered_rows(docs: DataFrame, doc_id: str = "doc_id", key: str = "row_key") -> DataFrame:
    """The documents with a column ``key`` that is unique and in the order of the ids.

    It is the id itself if ids are unique and none is null, else the place of the row in a
    sorted table written for it.
    """
    ids = docs.select(key_of(doc_id).alias("doc"))
    odd = ids.groupBy("doc").count().filter((F.col("count") > 1) | (F.col("doc") == NO_ID)).limit(1).count()
    if not odd:
        return docs.withColumn(key, F.col(doc_id).cast("long"))
    by = [F.col(doc_id), *(F.col(c) for c, kind in docs.dtypes if kind == "string")]
    return written(docs.orderBy(*by).withColumn(key, F.monotonically_increasing_id()), "numbered")


class WordHashes(dict):
    """64-bit hashes of words; the common ones are remembered, up to ``most``."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < self.most:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with all bits stirred (the finalizer of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Columns ``node`` and ``root``, the least node linked to it, for undirected edges.

    ``edges`` has the columns ``a`` and ``b``. Large-star and small-star steps alternate:
    every node's neighbours are linked to the least of them, first the larger ones, then
    the smaller ones, until nothing changes. Each step writes its table to the shared
    folder. Both steps aggregate a least neighbour per node and join it back, so that no
    node's neighbours ever meet in one row.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        name,
    )

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(least, "a")
        down = step.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(least.select("a", F.col("m").alias("b")).unionByName(down).distinct(), name)
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

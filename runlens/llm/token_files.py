"""Token ids of documents in block files with one shared zstandard dictionary.

Format: a table of blocks in ascending order of documents. A block has the ids of some
whole documents, each compressed on its own as a zstandard frame, and an index with each
document's id, number of tokens, and where its frame starts. ``dictionary`` is the digest
of the zstandard dictionary, which lies in a table of its own beside the blocks; where none could
be trained it is empty, and ``reason`` there says why. To read
one short document, filter blocks by ``first_doc`` and ``last_doc``, take its index entry and
decompress only its frame. Ids take two bytes if the vocabulary allows it, else four.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.common import id_of, key_of, shared_folder, small, written
from runlens.llm.pieces import GROUP, encoder

BLOCK_BYTES = 4_000_000
# The dictionary is fit on this many documents at most, chosen by a hash of their ids, and
# on this many bytes of each. It only changes how well ids are compressed.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 8_192, 65_536
# What zstandard says of samples that are too few or unfit.
TOO_FEW = ("Src size is incorrect", "Cannot create Dictionary from provided samples")

BLOCKS = """part int, block int, first_doc long, last_doc long, tokens long, width int, dictionary string,
    docs array<long>, counts array<long>, starts array<long>, payload binary"""


@dataclass(frozen=True)
class TokenFiles:
    blocks: str
    dictionaries: str


def encoded(docs: DataFrame, tokenizer: str, blanks: bool, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Columns ``doc``, ``n_tokens`` and ``ids``, the ids of each whole text and the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = encoder(tokenizer, blanks), np.array([end_id], dtype="<u4").tobytes()
        kind = "<u2" if max(pieces.tokenizer.get_vocab_size(), end_id + 1) <= 65_536 else "<u4"
        for batch in in_larger(batches):
            texts = (value.as_py() for value in batch.column("text"))
            for start, ids in in_runs(pieces.encode(texts), 16_000_000):
                arrays = [np.frombuffer(x + end, dtype="<u4").astype(kind) for x in ids]
                yield pa.record_batch(
                    [
                        batch.column("doc").slice(start, len(ids)),
                        pa.array([len(x) for x in arrays], pa.int64()),
                        pa.array([x.tobytes() for x in arrays], pa.binary()),
                        pa.array([x.dtype.itemsize for x in arrays], pa.int32()),
                    ],
                    names=["doc", "n_tokens", "ids", "width"],
                )

    rows = docs.select(key_of(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc long, n_tokens long, ids binary, width int")


def in_larger(batches: Iterator[pa.RecordBatch], most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The rows in batches of up to ``most`` bytes each; larger ones stay as they are.

    The encoder looks pieces up for a group of texts at once, which is dear for a few short ones.
    """
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def in_runs(values: Iterator[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of values with about ``most`` bytes each, and the place of their first one."""
    run, size, start = [], 0, 0
    for value in values:
        run.append(value)
        size += len(value)
        if size >= most:
            yield start, run
            start, run, size = start + len(run), [], 0
    if run:
        yield start, run


def trained(rows: DataFrame) -> tuple[bytes, str | None]:
    """A zstandard dictionary for the ids in ``rows``; empty, with zstandard's reason, if they are too few or unfit."""
    chosen = rows.select("doc").distinct().orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_DOCUMENTS)
    sample = rows.join(F.broadcast(chosen), "doc").select("doc", F.substring("ids", 1, SAMPLE_BYTES).alias("ids"))
    texts = [bytes(r.ids) for r in sample.orderBy("doc", "ids").limit(SAMPLE_DOCUMENTS).collect()]
    if not texts:
        return b"", "no samples"
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes(), None
    except zstandard.ZstdError as error:
        if not any(known in str(error) for known in TOO_FEW):
            raise
        return b"", str(error)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    blanks: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
) -> TokenFiles:
    """Encode every whole text and write the ids in ascending order of the document id.

    Null texts are empty and only have the end id. Null ids come first. Rows that share an
    id are ordered by their ids. An empty table gives no blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/llm/token-files-{uuid.uuid4().hex}"
    rows = written(encoded(docs, tokenizer, blanks, end_id, doc_id, text), "encoded")
    dictionary, reason = trained(rows)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), reason)], "dictionary string, content binary, reason string").coalesce(
        1
    ).write.parquet(f"{path}/dictionaries")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(dict_data=as_dictionary(dictionary)).compress
        docs, counts, starts, frames, size, width = [], [], [0], [], 0, 2

        def row() -> pa.RecordBatch:
            values = (part, block, docs[0], docs[-1], sum(counts), width, digest, docs, counts, starts, b"".join(frames))
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK_SCHEMA.names, values))], schema=BLOCK_SCHEMA)

        for batch in batches:
            for doc, n, ids, w in zip(*(batch.column(c) for c in ("doc", "n_tokens", "ids", "width"))):
                frame = squeeze(ids.as_py())
                if docs and (size + len(frame) > BLOCK_BYTES or w.as_py() != width):
                    yield row()
                    docs, counts, starts, frames, size, block = [], [], [0], [], 0, block + 1
                width, size = w.as_py(), size + len(frame)
                docs.append(doc.as_py())
                counts.append(n.as_py())
                starts.append(size)
                frames.append(frame)
        if docs:
            yield row()

    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc", "n_tokens", "ids")
    ordered.mapInArrow(pack, BLOCKS).write.parquet(f"{path}/blocks")
    return TokenFiles(f"{path}/blocks", f"{path}/dictionaries")


BLOCK_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("first_doc", pa.int64()),
        ("last_doc", pa.int64()),
        ("tokens", pa.int64()),
        ("width", pa.int32()),
        ("dictionary", pa.string()),
        ("docs", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def as_dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def dictionaries(spark: SparkSession, files: TokenFiles) -> dict[str, bytes]:
    """Dictionaries by digest; one per write, at most ``DICTIONARY_BYTES`` each."""
    rows = spark.read.schema("dictionary string, content binary").parquet(files.dictionaries)
    return {r.dictionary: bytes(r.content) for r in rows.collect()}


def unpacked(frame: bytes, width: int, expand) -> np.ndarray:
    return np.frombuffer(expand(frame), dtype="<u2" if width == 2 else "<u4").astype("<u4")


def read_document(spark: SparkSession, files: TokenFiles, doc_id: int) -> list[list[int]]:
    """Ids of the rows with this id; only the blocks that may hold it are read."""
    blocks = spark.read.schema(BLOCKS).parquet(files.blocks)
    by_digest, found = dictionaries(spark, files), []
    hits = blocks.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    place = hits.select(
        "part", "block", "width", "dictionary", "starts", "payload", F.posexplode("docs").alias("i", "doc")
    ).filter(F.col("doc") == doc_id)
    start, end = F.element_at("starts", F.col("i") + 1), F.element_at("starts", F.col("i") + 2)
    frames = place.select("part", "block", "i", "width", "dictionary", F.substring("payload", start + 1, end - start).alias("f"))
    for r in frames.orderBy("part", "block", "i").collect():
        expand = zstandard.ZstdDecompressor(dict_data=as_dictionary(by_digest[r.dictionary])).decompress
        found.append(unpacked(bytes(r.f), r.width, expand).tolist())
    return found


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per document in the files: place, sizes and a checksum of its ids.

    ``start`` counts the ids of all documents before it. It takes three levels of sums: of
    parts, of blocks in a part, and within a block.
    """
    blocks, by_digest = spark.read.schema(BLOCKS).parquet(files.blocks), dictionaries(spark, files)
    index = blocks.select("part", "block", "tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.join(parts, "part").select(
        "part", "block", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base")
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = {
            digest: zstandard.ZstdDecompressor(dict_data=as_dictionary(content)).decompress
            for digest, content in by_digest.items()
        }
        for batch in batches:
            for row in batch.to_pylist():
                counts, starts, payload = np.array(row["counts"]), row["starts"], row["payload"]
                sums = [
                    zlib.crc32(unpacked(payload[a:b], row["width"], expand[row["dictionary"]]).tobytes())
                    for a, b in zip(starts, starts[1:])
                ]
                n = len(counts)
                yield pa.record_batch(
                    [
                        pa.array(row["docs"], pa.int64()),
                        pa.array(row["base"] + np.cumsum(counts) - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(starts[:-1], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array([row["dictionary"]] * n, pa.string()),
                    ],
                    names=["doc", "start", "n_tokens", "ids_crc32", "part", "block", "frame_start", "frame_bytes", "dictionary"],
                )

    rows = blocks.join(small(written(bases, "bases")), ["part", "block"]).select(*blocks.columns, "base")
    out = rows.mapInArrow(
        unpack,
        "doc long, start long, n_tokens long, ids_crc32 long, part int, block int, frame_start long, "
        "frame_bytes long, dictionary string",
    )
    return out.select(id_of("doc").alias("doc_id"), *out.columns[1:])

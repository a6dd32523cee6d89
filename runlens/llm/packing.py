"""Packing of documents into training sequences: concatenate and cut.

A first pass encodes the documents, writes their ids and counts the tokens of each input
partition. Prefix sums over these totals give every document its place in one long row of
ids. A second pass cuts that row every ``length`` ids. Only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import id_of, key_of, small, written
from runlens.llm.pieces import REMEMBERED, encoder
from runlens.llm.token_files import in_larger, in_runs

ROWS = "part int, doc long, local_start long, n_tokens long, width int, ids binary"
PIECES = """doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,
    from_before boolean, goes_on boolean"""


def placed(docs: DataFrame, tokenizer: str, end_id: int, blanks: bool, doc_id: str, text: str, remembered: int) -> DataFrame:
    """Ids of each document and its start in the long row of all ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = encoder(tokenizer, blanks, remembered), np.array([end_id], dtype="<u4").tobytes()
        kind = "<u2" if max(pieces.tokenizer.get_vocab_size(), end_id + 1) <= 65_536 else "<u4"
        part, total = TaskContext.get().partitionId(), 0
        for batch in in_larger(batches):
            texts = (value.as_py() for value in batch.column("text"))
            for first, ids in in_runs(pieces.encode(texts), 16_000_000):
                arrays = [np.frombuffer(x + end, dtype="<u4").astype(kind) for x in ids]
                sizes = np.array([len(x) for x in arrays], dtype=np.int64)
                n = len(ids)
                yield pa.record_batch(
                    [
                        pa.array([part] * n, pa.int32()),
                        batch.column("doc").slice(first, n),
                        pa.array(total + np.cumsum(sizes) - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([x.dtype.itemsize for x in arrays], pa.int32()),
                        pa.array([x.tobytes() for x in arrays], pa.binary()),
                    ],
                    names=["part", "doc", "local_start", "n_tokens", "width", "ids"],
                )
                total += int(sizes.sum())

    rows = docs.select(key_of(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = written(rows.mapInArrow(encode, ROWS), "encoded")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    joined = rows.join(small(written(bases, "bases")), "part")
    return joined.select("doc", (F.col("base") + F.col("local_start")).alias("global_start"), "width", "ids")


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 2048,
    blanks: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    ``from_before`` and ``goes_on`` mark pieces at a boundary: the document began in the
    sequence before, or continues in the next. Null texts are empty and only have the end
    id; null ids stay null; rows that share an id are documents of their own; an empty
    table gives no pieces; other columns are ignored. With ``with_ids`` the ids are there too. ``remembered``
    is the number of text pieces whose ids a worker keeps; it changes time and memory only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, start, width, ids in zip(*(batch.column(c) for c in ("doc", "global_start", "width", "ids"))):
                row = np.frombuffer(ids.as_py(), dtype="<u2" if width.as_py() == 2 else "<u4").astype("<u4")
                at, n = start.as_py(), len(row)
                edges = [0, *range(length - at % length, n, length), n]
                for a, b in zip(edges, edges[1:]):
                    raw = row[a:b].tobytes()
                    piece = (a, b - a, zlib.crc32(raw), n, (at + a) // length, (at + a) % length, a > 0, b < n)
                    out.append((doc.as_py(), *piece, raw))
                if len(out) >= 20_000:
                    yield as_batch(out)
                    out = []
            if out:
                yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        names = "doc start length ids_crc32 doc_tokens sequence_id offset from_before goes_on".split()
        if with_ids:
            arrays, names = [*arrays, pa.array(columns[-1], pa.binary())], [*names, "ids"]
        return pa.record_batch(arrays, names=names)

    pieces = placed(docs, tokenizer, end_id, blanks, doc_id, text, remembered).mapInArrow(
        cut, PIECES + (", ids binary" if with_ids else "")
    )
    return pieces.select(id_of("doc").alias("doc_id"), *pieces.columns[1:])

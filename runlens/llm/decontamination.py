"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: each row holds the postings of one block of documents,
terms in order, each with the ascending positions where it stands. Test items are cut into
windows of words. In each block a window is looked up from its rarest term: the positions of
that term, less its offset in the window, are the candidates, and the other terms' lists
are intersected with them, rarer ones first. Nothing is shuffled, and a block's document is
never split, so counts per document are whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import id_of, key_of, mixed, written

WINDOW = 10
BLOCK_BYTES = 8_000_000
# Items are searched in sets of about so many bytes of text, one set after the other; each goes to all tasks.
SET_BYTES = 2_000_000
# Positions left free between documents, so that no match reaches into the next one.
GAP = 4_096

INDEX = """part int, block int, docs array<long>, counts array<long>, terms binary, sizes binary, places binary"""
FOUND = """part int, block int, i int, doc long, n_words long, spans array<struct<a:long,b:long>>,
    items array<string>, near array<string>"""

# Words of more bytes are hashed one by one.
LONG_WORD = 64

# Word bytes by byte: digits, letters with A-Z as a-z, and all bytes from 0x80; else 0.
LETTERS = np.zeros(256, dtype=np.uint8)
for _byte in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    LETTERS[_byte] = _byte
for _byte in range(0x41, 0x5B):
    LETTERS[_byte] = _byte + 32


# Keeps the first bytes of eight, by their number.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of all texts in order, and the number of words of each text.

    A word is taken eight bytes at a time; all bits are stirred after each of them, so that no sums of
    letters can cancel out.
    """
    raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    letters = np.zeros(len(raw) + 8, dtype=np.uint8)
    letters[: len(raw)] = LETTERS[raw]
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[1:] = letters[: len(raw)] > 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    sizes = ends - starts
    eights = np.ndarray(len(raw), dtype="<u8", buffer=letters, strides=(1,))
    digests = sizes.astype(np.uint64)
    some = np.flatnonzero(sizes <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        some = some[sizes[some] > step]
        if not len(some):
            break
        part = eights[starts[some] + step] & _KEEP[np.minimum(sizes[some] - step, 8)]
        digests[some] = mixed(digests[some] ^ part) + np.uint64(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digests[i] = xxhash.xxh3_64_intdigest(letters[starts[i] : ends[i]].tobytes())
    limits = np.cumsum([len(text) + 1 for text in texts])
    return digests, np.diff(np.searchsorted(starts, limits), prepend=0)


def first_places(counts: np.ndarray) -> np.ndarray:
    """Position of the first word of each document of a block."""
    return np.cumsum(counts) - counts + GAP * np.arange(1, len(counts) + 1)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all words of all whole texts, one row per block, written."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            column, first, size = batch.column("text").cast(pa.binary()), 0, 0
            texts: list[bytes] = []
            for i, value in enumerate(column):
                texts.append(value.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES or i + 1 == len(column):
                    yield postings(part, block, batch.column("doc").slice(first, len(texts)), texts)
                    texts, first, size, block = [], i + 1, 0, block + 1

    rows = docs.select(key_of(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(rows.mapInArrow(index, INDEX), "positions")


def postings(part: int, block: int, docs: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    digests, counts = words_of(texts)
    places = np.repeat(first_places(counts) - (np.cumsum(counts) - counts), counts) + np.arange(len(digests))
    order = np.argsort(digests, kind="stable")
    digests, places = digests[order], places[order]
    new = np.flatnonzero(np.diff(digests, prepend=~digests[:1])) if len(digests) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(new, append=len(digests))
    steps = np.diff(places, prepend=0)
    steps[new] = places[new]
    width = "<u4" if not len(places) or places.max() < 2**32 else "<u8"
    row = {
        "part": part,
        "block": block,
        "docs": docs.to_pylist(),
        "counts": counts.tolist(),
        "terms": digests[new].tobytes(),
        "sizes": sizes.astype("<u4").tobytes(),
        "places": steps.astype(width).tobytes(),
    }
    kinds = [pa.int32()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 3
    return pa.RecordBatch.from_pylist([row], schema=pa.schema(list(zip(row, kinds))))


class Block:
    """Postings of one block, ready for look-ups."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], dtype="<u8")
        sizes = np.frombuffer(row["sizes"], dtype="<u4").astype(np.int64)
        n = int(sizes.sum())
        steps = np.frombuffer(row["places"], dtype="<u4" if len(row["places"]) == 4 * n else "<u8")
        self.starts = np.cumsum(sizes) - sizes
        sums = np.cumsum(steps.astype(np.int64))
        self.places = sums - np.repeat(np.concatenate([[0], sums])[self.starts], sizes)
        self.sizes = sizes

    def lists_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the list of each term; length 0 if it is missing."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        if not len(self.terms):
            return np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        return self.starts[at], np.where(self.terms[at] == terms, self.sizes[at], 0)

    def occurrences(self, starts: np.ndarray, sizes: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """First positions of a window, given the lists of its terms, and where its rarest term stands.

        With ``slop`` a first position is one from which each term stands within so many
        places of where it should; which term is the rarest does not change whether there is one.
        """
        order = np.argsort(sizes, kind="stable")
        rarest = order[0]
        anchors = self.places[starts[rarest] : starts[rarest] + sizes[rarest]]
        found = anchors - rarest
        if slop:
            shifts = np.arange(-slop, slop + 1)
            found, anchors = (found[:, None] + shifts).ravel(), np.repeat(anchors, len(shifts))
        for k in order[1:]:
            own = self.places[starts[k] : starts[k] + sizes[k]]
            at = np.searchsorted(own, found + (k - slop))
            fits = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= found + (k + slop))
            found, anchors = found[fits], anchors[fits]
            if not len(found):
                break
        return found, anchors


class Windows:
    """Different windows of some items: terms by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], length: int):
        digests, counts = words_of([text.encode() for _, text in items]) if items else (np.zeros(0), [])
        held: dict[tuple[int, ...], set[str]] = {}
        end = 0
        for (name, _), n in zip(items, counts):
            words, end = digests[end : end + n].tolist(), end + n
            for i in range(max(n - length + 1, 1) if n else 0):
                held.setdefault(tuple(words[i : i + length]), set()).add(name)
        self.terms = np.array(sorted({t for window in held for t in window}), dtype=np.uint64)
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        by_length: dict[int, list] = {}
        for window, names in held.items():
            by_length.setdefault(len(window), []).append(([place[t] for t in window], sorted(names)))
        self.groups = [(np.array([w for w, _ in g]), [names for _, names in g]) for g in by_length.values()]


def search(index: DataFrame, items: DataFrame, window: int, near: int, item_id: str, text: str) -> DataFrame:
    """Matches of every item in every document, one row per document.

    ``spans`` are the word ranges of exact phrases, ``items`` their items; ``near`` has the
    items of which a window's terms all stand within ``near`` places of where they should.
    """
    chosen = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sets = max(1, math.ceil(size / SET_BYTES))
    parts = []
    for k in range(sets):
        some = chosen.filter(F.pmod(F.xxhash64("name", "text"), F.lit(sets)) == k)
        windows = Windows([(r.name_, r.text) for r in some.withColumnRenamed("name", "name_").collect()], window)
        if sets == 1:
            return matches(index, windows, near)
        # The driver holds one set at a time.
        parts.append(written(matches(index, windows, near), "matches"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("part", "block", "i").agg(
        F.first("doc").alias("doc"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )


def matches(index: DataFrame, windows: Windows, near: int) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield matches_in_block(row, windows, near)

    return index.mapInArrow(look, FOUND)


def matches_in_block(row: dict, windows: Windows, near: int) -> pa.RecordBatch:
    block, counts = Block(row), np.array(row["counts"], dtype=np.int64)
    n, firsts = len(counts), first_places(counts)
    spans: list[list] = [[] for _ in range(n)]
    exact: list[set] = [set() for _ in range(n)]
    close: list[set] = [set() for _ in range(n)]
    starts, sizes = block.lists_of(windows.terms)
    for terms, names in windows.groups:
        length = terms.shape[1]
        for w in np.flatnonzero(sizes[terms].min(axis=1) > 0):
            lists = starts[terms[w]], sizes[terms[w]]
            for slop in {0, near}:
                found, anchors = block.occurrences(*lists, slop)
                # A near match may begin before its document does; its terms stand in it.
                for doc, place in zip((np.searchsorted(firsts, anchors, side="right") - 1).tolist(), found.tolist()):
                    if slop == 0:
                        spans[doc].append((place - int(firsts[doc]), place - int(firsts[doc]) + length))
                        exact[doc].update(names[w])
                    close[doc].update(names[w])
    rows = {
        "part": pa.array([row["part"]] * n, pa.int32()),
        "block": pa.array([row["block"]] * n, pa.int32()),
        "i": pa.array(range(n), pa.int32()),
        "doc": pa.array(row["docs"], pa.int64()),
        "n_words": pa.array(row["counts"], pa.int64()),
        "spans": pa.array(
            [[{"a": a, "b": b} for a, b in sorted(set(s))] for s in spans],
            pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])),
        ),
        "items": pa.array([sorted(x) for x in exact], pa.list_(pa.string())),
        "near": pa.array([sorted(x) for x in close], pa.list_(pa.string())),
    }
    return pa.record_batch(list(rows.values()), names=list(rows))


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    near: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: its words, those hit, and the items that occur in it.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. An item of
    fewer words than ``window`` is one window; one without words never occurs. ``near``
    is the slack of proximity matches, which are reported in ``near_items`` (with the items
    that occur exactly) and hit no words; twice that and ``window`` have to be below ``GAP``.
    Null texts have no words, null ids stay null, repeated rows are judged alike, items of one id count
    once. Without documents there are no rows; without items nothing is hit.
    """
    if near and 2 * near + window >= GAP:
        raise ValueError(f"twice near and the window have to be below {GAP}")
    found = search(build_index(docs, doc_id, text), items, window, near, item_id, item_text)
    hit = F.expr(
        """aggregate(array_sort(spans), named_struct('end', 0L, 'n', 0L), (s, x) ->
              named_struct('end', greatest(s.end, x.b), 'n', s.n + greatest(0L, x.b - greatest(x.a, s.end))), s -> s.n)"""
    )
    return found.select(
        id_of("doc").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
        "items",
        F.col("near").alias("near_items"),
    )

"""Removal of byte strings that occur before, by distributed prefix doubling.

Names take the place of ranks: the name of a string of twice the length is made of the
names of its two halves, so equal strings have equal names at every length. Names grow
from one byte to 32 inside a task, where a text's positions lie side by side. From there on
Spark sorts (name, position) pairs, first by the 32-byte names and then by names of 100 bytes:

* All 100-byte windows of a text hold 69 strings of 32 bytes; the least name among them is the
  window's key. Neighbouring windows with one key form a run, of about 35 windows in
  prose. Equal windows have equal keys, so only a row per run is sorted. Runs whose key is unique
  are done.
* Runs with one key and equal contents are all repeats but the first. A run that is the
  only one of its content, or the first, is done unless another content shares its key.
* Those left are named window by window with 100 bytes, and sorted once more. Keys with
  very many such runs are split up by the names of their windows.

Each task first settles what repeats within its own batch of documents, so a string that
very many documents share reaches the sort once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import BROADCAST_ROWS, id_of, keyed_texts, small, written

SHORT = 32
PIECE = 1_000_000  # window starts that are named at once
LONGEST_RUN = 100
# Keys with more unsettled runs than this are split by the windows' names.
CROWDED = 2_000

# Kinds of rows: a run to sort, a run to sort whose key is known to be unsettled, a removed
# run, an unsettled run.
RUN, MARKED, REMOVED, OPEN = 0, 1, 2, 3
ROWS = "key long, content long, doc long, copy int, start long, n int, kind int"
NAMES = ["key", "content", "doc", "copy", "start", "n", "kind"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of strings made of two others, each given by its name."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def short_names(raw: np.ndarray) -> np.ndarray:
    names, length = BYTES[raw], 1
    while length < SHORT:
        names = pair(names[:-length], names[length:])
        length *= 2
    return names


BYTES = pair(np.arange(256, dtype=np.uint64) + np.uint64(1), np.full(256, 0xABCD, dtype=np.uint64))


def names_at(short: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of ``length`` bytes, 64 to 128, from those of 32: 64 first, then two that overlap."""
    middle = at + (length - 2 * SHORT)
    return pair(pair(short[at], short[at + SHORT]), pair(short[middle], short[middle + SHORT]))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def runs_of(raw: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows in some byte strings laid end to end.

    Gives key, content, first window, number of windows, and whether a window may repeat
    inside the run.
    """
    ends = np.cumsum(sizes)
    if len(raw) < length:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=bool),)
    short = short_names(raw)
    width = length - SHORT + 1
    keys = least_of(short, width)
    valid = np.ones(len(keys), dtype=bool)
    for end, size in zip(ends, sizes):
        valid[max(end - min(size, length - 1), 0) : end] = False
    at = np.flatnonzero(valid)
    keys = keys[at]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else [])
    n = np.diff(first, append=len(at))
    parts = -(-n // LONGEST_RUN)
    which = np.repeat(np.arange(len(n)), parts)
    offset = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST_RUN
    start, n, keys = at[first[which]] + offset, np.minimum(LONGEST_RUN, n[which] - offset), keys[first[which]]
    last = start + n - 1
    content = pair(pair(names_at(short, start, length), names_at(short, last, length)), n.astype(np.uint64))
    again = np.zeros(len(start), dtype=bool)
    span = np.arange(width + LONGEST_RUN - 1)
    for a in range(0, len(start), 20_000):
        s, m = start[a : a + 20_000], n[a : a + 20_000]
        found = short[np.minimum(s[:, None] + span, len(short) - 1)] == keys[a : a + 20_000, None]
        again[a : a + 20_000] = (found & (span < (m + width - 1)[:, None])).sum(axis=1) > 1
    return keys, content, start, n, again


def batch_of(columns: list) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, k, safe=False) for c, k in zip(columns, KINDS)]
    return pa.record_batch(arrays, names=NAMES)


def settle(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Settle what one place can: ``columns`` as in ``NAMES``, sorted by key, content, place.

    Of equal contents all but the first are removed. If a key has several contents, or a
    marked run, the first ones are unsettled.
    """
    key, content, doc, copy, start, n, kind = columns
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    first = new_key | np.concatenate([[True], content[1:] != content[:-1]])
    group = np.cumsum(new_key) - 1
    groups = group[-1] + 1
    unsettled = (np.bincount(group, weights=first, minlength=groups) > 1) | (
        np.bincount(group, weights=kind == MARKED, minlength=groups) > 0
    )
    kind = np.where(~first, REMOVED, np.where(unsettled[group], OPEN, RUN))
    return [key, content, doc, copy, start, n, kind]


def run_rows(texts: DataFrame, length: int) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, copies = batch.column("doc").to_numpy(), batch.column("copy").to_numpy()
            order = np.lexsort([copies, docs])
            column = batch.column("text").cast(pa.binary())
            found: list[list[np.ndarray]] = []
            pieces: list[bytes] = []
            owner: list[int] = []
            base: list[int] = []

            def flush() -> None:
                sizes = np.array([len(p) for p in pieces], dtype=np.int64)
                begin = np.cumsum(sizes) - sizes
                key, content, start, n, again = runs_of(np.frombuffer(b"".join(pieces), dtype=np.uint8), sizes, length)
                piece = np.searchsorted(begin, start, side="right") - 1
                own = np.array(owner, dtype=np.int64)[piece]
                place = start - begin[piece] + np.array(base, dtype=np.int64)[piece]
                found.append([key, content, docs[own], copies[own], place, n, np.where(again, MARKED, RUN)])

            size = 0
            for i in order:
                raw = column[int(i)].as_py()
                for a in range(0, len(raw) - length + 1, PIECE):
                    pieces.append(raw[a : a + PIECE + length - 1])
                    owner.append(i)
                    base.append(a)
                    size += len(pieces[-1])
                    if size >= PIECE:
                        flush()
                        pieces, owner, base, size = [], [], [], 0
            if pieces:
                flush()
            if not found or not sum(len(f[0]) for f in found):
                continue
            columns = [np.concatenate(c) for c in zip(*found)]
            # Runs are in the order of their places, which a stable sort keeps.
            order = np.lexsort([columns[1], columns[0]])
            columns = settle([c[order] for c in columns])
            key, kind = columns[0], columns[-1]
            yield from (batch_of(part) for part in sliced(joined_removed(columns)))
            for chosen, as_kind in ((kind == OPEN, OPEN), (kind == RUN, RUN)):
                yield from (batch_of([*part[:-1], np.full(len(part[0]), as_kind)]) for part in sliced([c[chosen] for c in columns]))
            unsettled = np.flatnonzero(kind == OPEN)
            one = unsettled[np.concatenate([[True], key[unsettled][1:] != key[unsettled][:-1]])] if len(unsettled) else unsettled
            yield from (batch_of([*part[:-1], np.full(len(part[0]), MARKED)]) for part in sliced([c[one] for c in columns]))

    return texts.mapInArrow(name, ROWS)


def sliced(columns: list[np.ndarray], rows: int = 50_000) -> Iterator[list[np.ndarray]]:
    for a in range(0, len(columns[0]), rows):
        yield [c[a : a + rows] for c in columns]


def joined_removed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The removed runs, with runs that follow one another made one."""
    removed = columns[-1] == REMOVED
    key, content, doc, copy, start, n, kind = (c[removed] for c in columns)
    order = np.lexsort([start, copy, doc])
    key, content, doc, copy, start, n, kind = (c[order] for c in (key, content, doc, copy, start, n, kind))
    if not len(key):
        return [key, content, doc, copy, start, n, kind]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] != start[:-1] + n[:-1])])
    first = np.flatnonzero(new)
    return [*(c[first] for c in (key, content, doc, copy, start)), np.add.reduceat(n, first), kind[first]]


def by_whole_keys(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole keys with at least ``rows`` rows, from batches in the order of their keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        if size >= rows and (len(held) and held[-1].column("key")[-1].as_py() != key[0]):
            yield pa.Table.from_batches(held)
            held, size = [], 0
        elif size >= rows and key[0] != key[-1]:
            cut = int(np.searchsorted(key != key[0], True))
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def settled(rows: DataFrame) -> DataFrame:
    """Removed and unsettled runs after all runs of a key have met."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_whole_keys(batches, 100_000):
            columns = [table.column(c).to_numpy() for c in NAMES]
            kind = columns[-1]
            through, here = kind >= REMOVED, kind < REMOVED
            marked = kind[here] == MARKED
            out = [[c[through] for c in columns]]
            if here.any():
                done = settle([c[here] for c in columns])
                # A marked run is among the unsettled already.
                keep = (done[-1] == REMOVED) | ((done[-1] == OPEN) & ~marked)
                done = [c[keep] for c in done]
                out += [joined_removed(done), [c[done[-1] == OPEN] for c in done]]
            for part in out:
                if len(part[0]):
                    yield batch_of(part)

    ordered = rows.repartition("key").sortWithinPartitions("key", "content", "doc", "copy", "start")
    return written(ordered.mapInArrow(reduce, ROWS), "runs")


def windows_settled(texts: DataFrame, unsettled: DataFrame, length: int) -> DataFrame:
    """Removed windows among the unsettled runs: ``doc``, ``copy``, ``start`` and ``n``."""
    crowded = unsettled.groupBy("key").count().filter(F.col("count") > CROWDED).select("key", F.lit(True).alias("crowded"))
    rows = unsettled.join(small(written(crowded, "crowded-keys")), "key", "left")
    rows = rows.select("doc", "copy", F.struct("key", "start", "n", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("run"))
    by_doc = written(rows.groupBy("doc", "copy").agg(F.collect_list("run").alias("runs")), "unsettled")
    wanted = texts.join(small(by_doc.select("doc", "copy")), ["doc", "copy"], "left_semi")
    schema = "key long, doc long, copy int, start long, n int, kind int, bytes binary"

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            seen: set[tuple[int, bytes]] = set()
            order = np.lexsort([batch.column("copy").to_numpy(), batch.column("doc").to_numpy()])
            for i in order.tolist():
                doc, copy, text, runs = (batch.column(c)[i].as_py() for c in ("doc", "copy", "text", "runs"))
                raw = text.encode()
                for run in sorted(runs, key=lambda r: r["start"]):
                    start, n, key = run["start"], run["n"], run["key"]
                    if not run["crowded"]:
                        out.append((key, doc, copy, start, n, OPEN, raw[start : start + n + length - 1]))
                        continue
                    for p in range(start, start + n):
                        window = raw[p : p + length]
                        again = (key, window) in seen
                        seen.add((key, window))
                        own = int(xx_key(key, window))
                        out.append((own, doc, copy, p, 1, REMOVED if again else OPEN, None if again else window))
                if len(out) >= 20_000:
                    yield as_rows(out)
                    out = []
            if out:
                yield as_rows(out)

    def as_rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["key", "doc", "copy", "start", "n", "kind", "bytes"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_whole_keys(batches, 20_000):
            removed = table.column("kind").to_numpy() == REMOVED
            columns = [table.column(c).to_numpy() for c in ("doc", "copy", "start", "n")]
            if removed.any():
                yield interval_batch([c[removed] for c in columns])
            here = np.flatnonzero(~removed)
            if not len(here):
                continue
            key = table.column("key").to_numpy()[here].view(np.uint64)
            doc, copy, start, n = (c[here] for c in columns)
            raw = np.frombuffer(b"".join(b.as_py() for b in table.column("bytes").take(pa.array(here))), dtype=np.uint8)
            sizes = n + length - 1
            begin, m = np.cumsum(sizes) - sizes, int(n.sum())
            inside = np.arange(m) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(n)), n)
            names = pair(names_at(short_names(raw), begin[row] + inside, length), key[row])
            _, first = np.unique(names, return_index=True)
            again = np.ones(m, dtype=bool)
            again[first] = False
            at = np.flatnonzero(again)
            if not len(at):
                continue
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])])
            head = np.flatnonzero(new)
            count, r = np.diff(head, append=len(at)), row[at[head]]
            yield interval_batch([doc[r], copy[r], start[r] + inside[at[head]], count])

    def interval_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k, safe=False) for c, k in zip(columns, kinds)], names=["doc", "copy", "start", "n"])

    rows = wanted.join(by_doc, ["doc", "copy"]).mapInArrow(contents, schema)
    ordered = rows.repartition("key").sortWithinPartitions("key", "doc", "copy", "start")
    return ordered.mapInArrow(compare, "doc long, copy int, start long, n long")


def xx_key(key: int, window: bytes) -> int:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(window, seed=key & (2**64 - 1))).view(np.int64)


def repeats(texts: DataFrame, length: int) -> DataFrame:
    """Per ``doc`` and ``copy`` the byte ranges to remove, merged and in order: ``spans``."""
    runs = settled(run_rows(texts, length))
    unsettled = runs.filter(F.col("kind") == OPEN).select("key", "doc", "copy", "start", "n")
    removed = runs.filter(F.col("kind") == REMOVED).select("doc", "copy", "start", F.col("n").cast("long").alias("n"))
    removed = removed.unionByName(windows_settled(texts, unsettled, length))
    ranges = removed.select("doc", "copy", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b")).alias("x"))
    return written(ranges.groupBy("doc", "copy").agg(F.collect_list("x").alias("ranges")), "removed")


def whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The range without the parts of characters at its edges."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def deduplicated(
    docs: DataFrame,
    length: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
    with_kept: bool = False,
    whole_characters: bool = False,
) -> DataFrame:
    """One row per document, without each byte covered by a string that starts earlier too.

    ``length`` (64 to 128) is the least number of bytes of a repeated string. Earlier means a smaller
    id, or the same document and a smaller start. Rows that share an id are documents of
    their own in the order of their texts; null ids come first. Null texts are empty. Shorter
    texts, and empty tables, have nothing to remove. With ``with_kept`` the column ``kept``
    has the remaining bytes. ``whole_characters`` leaves out of each cut what would split a
    UTF-8 character at its edges. Other columns are ignored.
    """
    if not 2 * SHORT <= length <= 4 * SHORT:
        raise ValueError("length must be from 64 to 128")
    texts = keyed_texts(docs, doc_id, text)
    ranges = repeats(texts, length)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for doc, text, found in zip(*(batch.column(c) for c in ("doc", "text", "ranges"))):
                raw, spans = text.as_py().encode(), []
                for x in sorted(found.as_py(), key=lambda x: x["a"]):
                    if spans and x["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["b"])
                    else:
                        spans.append([x["a"], x["b"]])
                if whole_characters:
                    spans = [x for x in (whole(raw, *span) for span in spans) if x[0] < x[1]]
                edges = [0, *(e for span in spans for e in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                digest = hashlib.sha256(kept).hexdigest()
                out.append((doc.as_py(), len(raw), len(raw) - len(kept), len(spans), digest, kept if with_kept else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    keys = ["doc", "copy"]
    few = ranges.count() <= BROADCAST_ROWS
    touched = F.broadcast(ranges.select(*keys)) if few else ranges.select(*keys)
    with_ranges = texts.join(touched, keys, "left_semi").join(ranges, keys) if few else texts.join(ranges, keys)
    rest = texts.join(touched, keys, "left_anti")
    rest = rest.select(
        "doc",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        F.when(F.lit(with_kept), F.col("text").cast("binary")).alias("kept"),
    )
    result = with_ranges.mapInArrow(cut, schema).unionByName(rest)
    return result.select(id_of("doc").alias("doc_id"), *[c for c in result.columns[1:] if with_kept or c != "kept"])

"""Near-duplicate documents: a Jaccard join on word n-grams with MinHash bands.

Documents with the same set of n-grams are one node, so exact copies never meet in pairs.
Nodes that share a band of their signature are candidates. The number of bands follows from
the rows in a band, the least similarity and the recall asked for. Candidates are verified
on their full sets. Bands of few nodes give pairs; bands of many nodes are cut into blocks,
and two blocks at a time are compared in one task, which returns counts and one link per
node, never pairs. Each pair counts once: where it shares a band of many nodes, the first
of these bands has it, otherwise the pair itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import components, id_of, key_of, mixed, small, word_hashes, written

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.9999, 4
# A band shared by more nodes than this is compared in blocks.
PAIRED = 32
# Blocks have about so many nodes, and about so many n-grams, if that is less nodes.
BLOCK_NODES, BLOCK_NGRAMS = 512, 500_000


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows so that a pair at ``similarity`` shares one with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def ngrams(text: str, n: int) -> np.ndarray:
    """Sorted different n-gram digests; a text of fewer words has one n-gram, all its words."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    one = np.fromiter(map(word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    length = min(n, len(words))
    total = np.zeros(len(words) - length + 1, dtype=np.uint64)
    for i in range(length):
        total = mixed(total + one[i : len(words) - length + 1 + i] + np.uint64(i + 1))
    return np.unique(total)


def node_of(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def signature(grams: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    """Band hashes of a set; one row of the signature per factor."""
    least = np.full(len(factors), 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(grams), 4_096):
        np.minimum(least, mixed_rows(grams[i : i + 4_096], factors), out=least)
    bands = np.zeros(len(factors) // rows, dtype=np.uint64)
    for row in least.reshape(-1, rows).T:
        bands = mixed(bands * np.uint64(31) + row + np.uint64(1))
    return bands


def mixed_rows(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    product = grams[None, :] * factors[:, None]
    return (product ^ (product >> np.uint64(32))).min(axis=1)


def factors_for(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(docs: DataFrame, n: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """Columns ``doc``, ``node``, ``n`` (n-grams) and ``bands``, one row per document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = factors_for(bands * rows)
        for batch in batches:
            sets = (ngrams(value.as_py(), n) for value in batch.column("text"))
            found = [(node_of(s), len(s), signature(s, factors, rows).view(np.int64) if len(s) else None) for s in sets]
            yield pa.record_batch(
                [
                    batch.column("doc"),
                    pa.array([f[0] for f in found], pa.binary()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.int64())),
                ],
                names=["doc", "node", "n", "bands"],
            )

    texts = docs.select(key_of(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(texts.mapInArrow(sketch, "doc long, node binary, n long, bands array<long>"), "sketches")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """Columns ``node`` and ``grams`` for the nodes in ``wanted`` (``doc``, ``node``)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                nodes, sets = some.column("node").to_pylist(), [ngrams(v.as_py(), n) for v in some.column("text")]
                right = [i for i, (node, s) in enumerate(zip(nodes, sets)) if node_of(s) == node]
                grams = pa.array([sets[i].view(np.int64) for i in right], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array([nodes[i] for i in right], pa.binary()), grams], names=["node", "grams"])

    texts = docs.select(key_of(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(small(wanted), "doc").select("node", "text")
    sets = written(rows.mapInArrow(collect, "node binary, grams array<long>"), "sets")
    # Rows that share an id and a text give a set twice.
    if sets.groupBy("node").count().filter("count > 1").limit(1).count():
        sets = written(sets.dropDuplicates(["node"]), "sets")
    return sets


def links_in_blocks(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Links of nodes that share a band of many nodes: ``node``, ``links`` and ``other``.

    ``other`` is one node linked to it, directly or through others of the two blocks.
    """
    large = members.filter(F.col("size") > PAIRED)
    own = large.groupBy("node").agg(F.collect_list(F.struct("band", "h")).alias("shared"))
    rows = large.join(own, "node").join(nodes.select("node", "mult"), "node").join(sets, "node")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_NODES, F.col("total") / BLOCK_NGRAMS)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band",
        "h",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("first"),
        "node",
        "mult",
        "shared",
        "grams",
    )

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        band, h, i, j = (k.as_py() for k in key)
        first = np.array(group.column("first").to_pylist())
        nodes, mult = group.column("node").to_pylist(), np.array(group.column("mult").to_pylist(), dtype=np.int64)
        grams = [np.array(g.values) for g in group.column("grams")]
        shared = [{(s["band"], s["h"]) for s in row.as_py() if s["band"] < band} for row in group.column("shared")]
        left, right = np.flatnonzero(first), np.arange(len(nodes)) if i == j else np.flatnonzero(~first)
        link = linked(grams, left, right, similarity) & ~share_earlier(shared, left, right)
        if i == j:
            np.fill_diagonal(link, False)
        links = np.zeros(len(nodes), dtype=np.int64)
        links[left] += link @ mult[right]
        if i != j:
            links[right] += link.T @ mult[left]
        root = least_reachable(link, left, right, len(nodes))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array([nodes[k] for k in some], pa.binary()),
                "links": pa.array(links[some], pa.int64()),
                "other": pa.array([nodes[root[k]] for k in some], pa.binary()),
            }
        )

    return rows.groupBy("band", "h", "i", "j").applyInArrow(compare, "node binary, links long, other binary")


def linked(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether each of ``left`` and each of ``right`` are similar enough; exact."""
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    values, place = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(len(grams)), sizes)
    often = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    use = often[place]
    owner, place = owner[use], column[place[use]]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    to_left, to_right = np.full(len(grams), -1), np.full(len(grams), -1)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    step = 2_048
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    edges = np.searchsorted(place, np.arange(0, int(often.sum()) + step, step))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        who, what = owner[a:b], place[a:b] - k * step
        one, two = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        here = to_left[who] >= 0
        one[to_left[who[here]], what[here]] = 1
        here = to_right[who] >= 0
        two[to_right[who[here]], what[here]] = 1
        common += one @ two.T
    common = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common * similarity.denominator >= union * similarity.numerator


def share_earlier(shared: list[set], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether two nodes also share a large band that comes before this one."""
    found = np.zeros((len(left), len(right)), dtype=bool)
    names = {name: k for k, name in enumerate(sorted({x for s in shared for x in s}))}
    by_band: dict[int, list[int]] = {}
    for band in sorted({name[0] for name in names}):
        row = [next((names[x] for x in s if x[0] == band), -1) for s in shared]
        by_band[band] = row
    for row in by_band.values():
        row = np.array(row)
        found |= (row[left][:, None] == row[right][None, :]) & (row[left] >= 0)[:, None]
    return found


def least_reachable(link: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each place the least one it is linked to, directly or not."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for rows, columns, m in ((left, right, link), (right, left, link.T)):
            reached = np.where(m, root[columns][None, :], n).min(axis=1, initial=n)
            root[rows] = np.minimum(root[rows], reached)
        if (root == before).all():
            return root


def near_duplicates(
    docs: DataFrame,
    n: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: its class, the number of documents linked to it, and its first copy.

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least
    ``similarity``; words are what white space separates. ``class_id`` is the least id of
    all documents linked with it, directly or not, ``copy_of`` the least id with the same
    n-gram set. Texts without words, and null texts, are linked to nothing. Rows that share
    an id count one by one; null ids count as less than all and show as null. Other
    columns are ignored.
    """
    exact, bands = Fraction(str(similarity)), bands_for(similarity, recall, rows)
    rows_of = sketches(docs, n, bands, rows, doc_id, text)
    nodes = written(
        rows_of.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc").alias("doc"), F.count("*").alias("mult"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    banded = nodes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    full = banded.groupBy("band", "h").agg(F.count("*").alias("size"), F.sum("n").alias("total")).filter("size > 1")
    members = written(banded.join(small(written(full, "bands")), ["band", "h"]), "members")
    wanted = written(members.select("node").distinct().join(nodes, "node").select("doc", "node"), "candidates")
    sets = sets_of(docs, wanted, n, doc_id, text)

    big = F.collect_list(F.when(F.col("size") > PAIRED, F.xxhash64("band", "h"))).alias("big")
    few = members.filter(F.col("size") <= PAIRED).join(members.groupBy("node").agg(big), "node")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(
        y,
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.h") == F.col("y.h"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.least("x.n", "y.n") * exact.denominator >= F.greatest("x.n", "y.n") * exact.numerator)
        & ~F.arrays_overlap("x.big", "y.big"),
    )
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    first, second = sets.select(F.col("node").alias("a"), F.col("grams").alias("s")), sets.select(F.col("node").alias("b"), F.col("grams").alias("t"))
    compared = pairs.join(first, "a").join(second, "b")
    compared = compared.select("a", "b", F.size(F.array_intersect("s", "t")).alias("c"), (F.size("s") + F.size("t")).alias("m"))
    good = F.col("c") * exact.denominator >= (F.col("m") - F.col("c")) * exact.numerator
    pairs = written(compared.filter(good).select("a", "b"), "pairs")
    blocks = written(links_in_blocks(members, nodes, sets, exact), "block-links")

    edges = pairs.unionByName(blocks.select(F.col("node").alias("a"), F.col("other").alias("b")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mult = nodes.select(F.col("node").alias("b"), "mult")
    links = both.join(mult, "b").select(F.col("a").alias("node"), F.col("mult").alias("links"))
    links = links.unionByName(blocks.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(edges, "near-duplicates")
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("doc").alias("least"))
    known = roots.join(least, "root").select("node", "least")
    about = nodes.join(known, "node", "left").join(links, "node", "left")
    about = about.select(
        "node",
        F.coalesce("least", "doc").alias("class"),
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.col("doc").alias("copy"),
    )
    result = rows_of.select("doc", "node").join(small(written(about, "classes")), "node", "left")
    return result.select(
        id_of("doc").alias("doc_id"),
        F.when(F.col("class").isNull(), id_of("doc")).otherwise(id_of("class")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("copy").isNull(), id_of("doc")).otherwise(id_of("copy")).alias("copy_of"),
    )

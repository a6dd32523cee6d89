"""Merkle manifest of a dataset: a tree of digests per group, and one over the groups.

Rows of a group stand in order, and every ``fanout`` neighbours have one parent. A level
is a slot pivot: conditional aggregates spread a parent's children into one column per slot.
The columns put together are hashed into the parent; the columns without a child's own are
its siblings, which are added to the proof of every row below that child. Rows are shuffled once
per several levels: a block of neighbours keeps its place until it has shrunk to one node.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import small, written

FANOUT = 2
# Neighbours in a block, about: a block's rows with their proofs are one row of some 200 KB.
BLOCK = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def in_order(rows: DataFrame, tree: str, by: Sequence[str]) -> DataFrame:
    """The rows with ``place``, from 0 within their tree in the order of ``by``, and ``n``, the rows of the tree.

    Rows are sorted by ranges and numbered within their partition; sums of the counts per
    partition and tree tell how many rows of the tree lie in partitions before. So a tree with most of
    the rows is spread like any other. ``by`` has to order rows fully, up to equal rows.
    """
    spread = rows.repartitionByRange(tree, *by).sortWithinPartitions(tree, *by)
    laid = written(spread.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "in-order")
    runs = written(laid.groupBy("part", tree).agg(F.min("at").alias("first"), F.count("*").alias("own")), "runs")
    all_runs = Window.partitionBy(tree)
    before = all_runs.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.select(
        "part",
        tree,
        "first",
        F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"),
        F.sum("own").over(all_runs).alias("n"),
    )
    placed = laid.join(small(written(sums, "runs")), ["part", tree])
    return placed.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def levels_in(block: int, fanout: int) -> int:
    return max(1, int(math.log(block, fanout) + 1e-9))


def one_level(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of the nodes of blocks; trees of one node stay as they are."""
    parent, slot = F.floor(F.col("place") / fanout).cast("long"), F.col("place") % fanout
    child = F.struct("digest", "members")
    slots = [f"slot_{k}" for k in range(fanout)]
    pivot = nodes.groupBy("tree", "n", "block", parent.alias("place")).agg(
        *(F.first(F.when(slot == k, child), ignorenulls=True).alias(name) for k, name in enumerate(slots))
    )
    column = [F.coalesce(F.col(f"{name}.digest"), F.lit("")) for name in slots]

    def joined(some: Sequence[Column]) -> Column:
        return F.concat(F.lit(""), *some)

    def below(k: int) -> Column:
        """Rows below a slot, their proofs longer by the other slots."""
        siblings = F.struct(joined(column[:k]).alias("before"), joined(column[k + 1 :]).alias("after"))
        rows = F.transform(
            F.col(f"{slots[k]}.members"),
            lambda m: F.struct(m["row"].alias("row"), F.concat(m["path"], F.array(siblings)).alias("path")),
        )
        return F.coalesce(rows, F.array().cast(nodes.schema["members"].dataType))

    grows = F.col("n") > 1
    return pivot.select(
        "tree",
        "block",
        "place",
        F.when(grows, F.sha2(joined(column), 256)).otherwise(F.col("slot_0.digest")).alias("digest"),
        F.when(grows, F.concat(*(below(k) for k in range(fanout)))).otherwise(F.col("slot_0.members")).alias("members"),
        F.ceil(F.col("n") / fanout).cast("long").alias("n"),
    )


def climbed(nodes: DataFrame, fanout: int) -> DataFrame:
    """Blocks as one node each, with the rows they hold and the rows' proofs inside the block.

    ``nodes`` has ``tree``, ``n``, ``place``, ``digest`` and ``row``. ``place`` of the result is the block's.
    """
    steps = levels_in(BLOCK, fanout)
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    nodes = nodes.select(
        "tree",
        "n",
        F.floor(F.col("place") / fanout**steps).cast("long").alias("block"),
        "place",
        "digest",
        F.array(F.struct("row", no_path.alias("path"))).alias("members"),
    ).repartition("tree", "block")
    for _ in range(steps):
        nodes = one_level(nodes, fanout)
    return written(nodes.select("tree", "n", "place", "digest", "members"), "merkle-blocks")


def proven(leaves: DataFrame, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """The root of every tree (``tree``, ``digest``) and the tables of blocks on the way, lowest first."""
    tables = [climbed(leaves, fanout)]
    while tables[-1].agg(F.max("n")).first()[0] not in (None, 1):
        above = tables[-1].select("tree", "n", "place", "digest", F.col("place").alias("row"))
        tables.append(climbed(above, fanout))
    return tables[-1].select("tree", "digest"), tables


def with_paths(tables: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """Rows of the lowest table with their whole proofs; ``tops`` has ``tree``, ``path`` and columns to pass on.

    It goes down from one row per tree to blocks and to rows. Each join has one row per key on both sides.
    """
    above = tops.withColumn("place", F.lit(0).cast("long"))
    kept = [c for c in tops.columns if c not in ("tree", "path")]
    for depth, table in enumerate(reversed(tables)):
        blocks = table.select("tree", "place", "members").join(above, ["tree", "place"])
        rows = blocks.select("tree", "path", *kept, F.explode("members").alias("m"))
        last = depth == len(tables) - 1
        above = rows.select(
            "tree", F.col("m.row").alias("row" if last else "place"), F.concat("m.path", "path").alias("path"), *kept
        )
    return above


def manifest(docs: DataFrame, fanout: int = FANOUT, changed: Column | None = None) -> DataFrame:
    """One row per document: its leaf, the roots above it, and its proof.

    A leaf is the digest of the row's id, source, lang, size and text. Per lang, leaves ascend by id;
    while there are several nodes, every ``fanout`` consecutive ones become their digest, and so do what is left at
    the end. The nodes that remain, ordered by lang (null first, then by UTF-8 bytes), give the root likewise.
    ``proof`` lists, level by level, the digests ``before`` and ``after`` the row's own node.

    Where the condition ``changed`` holds, the row is tampered with: its size is one more (null
    stays null). ``folded_root`` is recomputed from such a leaf, or the true one, and the true siblings;
    ``verified`` says that it equals the root. Null ids come first; rows that share an id
    are ordered by their leaves, so repeated rows are told apart by their places only and have proofs of
    their own. Empty texts differ from null ones. An empty table gives no rows; columns
    other than the five are ignored. Missing columns are an error.
    """
    if fanout < 2:
        raise ValueError("a node needs two children or more")
    number = F.col("n_chars")
    leaf = digest(*(field(F.col(name)) for name in FIELDS))
    other = digest(*(field(number + 1 if name == "n_chars" else F.col(name)) for name in FIELDS))
    rows = docs.select(
        F.col("doc_id"),
        # An order of trees that tells null from the empty name.
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf.alias("leaf"),
        F.when(F.lit(False) if changed is None else changed, other).alias("changed_leaf"),
    )
    leaves = in_order(written(rows, "leaves"), "tree", ["doc_id", "leaf"])
    leaves = leaves.select("tree", "n", "place", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "changed_leaf").alias("row"))
    subroots, tables = proven(leaves, fanout)
    trees = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    trees = in_order(written(trees, "trees"), "tree", ["name"])
    trees = trees.select("tree", "n", "place", "digest", F.struct("name", F.col("digest").alias("subroot")).alias("row"))
    roots, top_tables = proven(trees, fanout)
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    tops = with_paths(top_tables, roots.select("tree", no_path.alias("path"), F.col("digest").alias("root")))
    tops = written(tops.select(F.col("row.name").alias("tree"), "path", F.col("row.subroot").alias("subroot"), "root"), "tops")
    found = with_paths(tables, tops)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    start = F.coalesce(F.col("row.changed_leaf"), F.col("row.leaf"))
    folded = F.aggregate("path", start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    found = found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.leaf").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        F.col("path").alias("proof"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

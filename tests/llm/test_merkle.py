"""The manifest against a tree built in plain Python, for two and three children a node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from runlens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [*row[:3], None if row[3] is None else row[3] + more, row[4]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The root over some nodes, and for each the siblings before and after it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // fanout * fanout : a // fanout * fanout + fanout]
            paths[i].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], paths


def brute(rows, fanout):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0], leaf_of(row), row))
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(langs[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *climb([leaf for _, leaf, _ in leaves], fanout)))
    root, tops = climb([subroot for _, subroot, _ in trees], fanout) if trees else (None, [])
    out = []
    for (leaves, subroot, paths), top in zip(trees, tops):
        for (doc, leaf, row), path in zip(leaves, paths):
            tampered = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            h = leaf_of(row, 1) if tampered else leaf
            for before, after in path + top:
                h = sha(before, h, after)
            out.append((doc, leaf, subroot, root, sha(*(a + b for a, b in path + top)), h, h == root))
    return out


def some_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en"] * 6 + ["de", "é", None, ""]), rng.choice([1, 7, None]), f"text {i}") for i in range(700)]
    rows += [(5, "a", "en", 1, "same id, other text"), (7, "a", "en", 1, "twice"), (7, "a", "en", 1, "twice")]
    rows += [(None, None, None, None, None), (None, "x", "en", 3, ""), (None, "x", "en", 3, None), (900, "a", "alone", 2, "é" * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("fanout", "block"), [(2, 256), (2, 8), (3, 10)])
def test_manifest(spark, fanout, block, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = some_rows()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text AS tree", "doc_id AS place", "lang AS digest").repartition(5)
    found = merkle.manifest(frame, fanout, changed=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = [tuple(r) for r in found.select(*COLUMNS).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, fanout)))
    assert {r[-1] for r in got} == {True, False}


def test_proofs_lead_to_the_root(spark):
    rows = some_rows()[:200]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        h = r.leaf
        for step in r.proof:
            h = sha(step.before, h, step.after)
        assert h == r.root and r.verified


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, "a", "de", 1, "x")]])
def test_small_tables(spark, rows):
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "subroot", "root").collect()
    assert sorted(map(tuple, found)) == sorted((r[0], r[2], r[3]) for r in brute(rows, 2))

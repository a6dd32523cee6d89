"""The registered queries on training text over given tables: against their SQL, or brute force where there is none."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as registered
from runlens.llm import queries, quality_classifier
from runlens.llm.queries import SHARDS, tokenizer
from tests.compare import differences
from tests.llm.test_operators import brute_dedup, ids, same
from tests.llm.test_pipeline import BRUTE, check_packed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return sorted((r["doc_id"], r["text"] or "") for r in table.to_pylist())


def found(spark, name):
    return registered.queries()[name](spark, SF).collect()


def test_all_queries_on_training_text_are_registered():
    names = sorted(queries.QUERIES, key=lambda name: int(name[2:].split("_")[0]))
    assert [name.split("_")[0] for name in names] == [f"op{n}" for n in range(1, 14)]
    assert {*names, "pipeline"} <= {*registered.queries()}


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_gives_what_its_sql_gives(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert differences(registered.queries()[name](spark, SF), connection, registered.oracle_sql()[name]) == []


def test_token_files(spark, rows):
    wanted, start = [], 0
    for doc, text in rows:
        e = ids("byte_bpe_50k.json", text, 2)
        wanted.append((doc, start, len(e), zlib.crc32(e.tobytes())))
        start += len(e)
    same([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found(spark, "op2_token_files")], wanted)


def test_sharding(spark, rows):
    n, owner = 65_537, {}
    orders = []
    for name in sorted(SHARDS):
        d = hashlib.sha256(name.encode()).digest()
        orders.append((name, int.from_bytes(d[:8], "big") % n, int.from_bytes(d[8:16], "big") % (n - 1) + 1))
    at = dict.fromkeys(SHARDS, 0)
    while len(owner) < n:
        for name, offset, skip in orders:
            while at[name] < n and (offset + at[name] * skip) % n in owner:
                at[name] += 1
            if at[name] < n:
                owner[(offset + at[name] * skip) % n] = name
    slot = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) % n
    same(map(tuple, found(spark, "op3_sharding")), [(d, slot(d), owner[slot(d)]) for d, _ in rows])


def test_packing(spark, rows):
    check_packed(found(spark, "op6_packing"), rows)


def test_suffix_dedup(spark, rows):
    same(map(tuple, found(spark, "op7_suffix_dedup")), brute_dedup(rows))


def test_token_counts(spark, rows):
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")).encode
    counts = [(d, len(t.encode()), len(encode(t))) for d, t in rows]
    same(map(tuple, found(spark, "op8_token_counts")), [(*c, c[2] > 4096) for c in counts])


def test_quality_classifier(spark, rows):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    target = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    n, grams = quality_classifier.BUCKETS, {d: quality_classifier.features(t, quality_classifier.BUCKETS) for d, t in rows}
    raw, good = collections.Counter(), collections.Counter()
    for d, f in grams.items():
        raw.update(f.tolist())
        good.update(f.tolist() if d in target else [])
    every, some = sum(raw.values()) + n, sum(good.values()) + n
    share = lambda b: (raw[b] + 1) / every
    weight = {d: sum(math.log((good[b] + n * share(b)) / some / share(b)) for b in f.tolist()) for d, f in grams.items()}
    out = found(spark, "op10_quality_classifier")
    assert sorted(r.doc_id for r in out) == [d for d, _ in rows]
    assert np.allclose([r.weight for r in out], [weight[r.doc_id] for r in out])
    noise = np.array([r.key - r.weight for r in out])
    assert len(set(noise.tolist())) > 0.9 * len(out) and -4 < noise.min() and abs(noise.mean() - 0.577) < 0.4
    order = sorted(out, key=lambda r: (-r.key, r.doc_id))
    k = math.ceil(len(target) / len({r["doc_id"] for r in labels}) * len(rows))
    assert {r.doc_id for r in out if r.kept} == {r.doc_id for r in order[:k]}


def test_pipeline(spark):
    documents = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [tuple(r.values()) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    for brute in BRUTE.values():
        documents = brute(documents, items)
    check_packed(found(spark, "pipeline"), documents)

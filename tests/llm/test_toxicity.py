"""Toxicity by compression distance: held-out accuracy, and rows of all kinds."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import toxicity

BAD = ["villain", "wretchedly", "scoundrel", "blockhead", "despicable"]
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def text(rng, toxic, words):
    out = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words)]
    return " ".join(rng.choice(BAD) if toxic and rng.random() < 0.08 else w for w in out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [(i, int(rng.random() < 0.2)) for i in range(1_500)]
    return [(i, text(rng, y, rng.randint(40, 200)), y) for i, y in made]


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame([(i, y, None) for i, _, y in rows], "doc_id long, toxic int, text string").select("doc_id", "toxic")


def test_held_out_texts_are_told_apart(tables, rows):
    docs, labels = tables
    found = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    good = np.sort([found[i].score for i, _, y in rows if found[i].held_out and not y])
    bad = [found[i].score for i, _, y in rows if found[i].held_out and y]
    assert np.searchsorted(good, bad).mean() / len(good) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert np.mean(np.array(bad) >= 0.5) > 0.7 and np.mean(good >= 0.5) < 0.03


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(tuple(r) for r in toxicity.scored(docs, some).collect()) for some in (labels, turned)]
    assert scores[0] == scores[1]


def test_rows_of_all_kinds(spark, tables):
    docs, labels = tables
    odd = [(None, None), (None, ""), (3, None), (9_001, " \n\t"), (9_002, "é" * 60_000), (9_003, " ".join(BAD) * 400), (9_003, "again"), (9_003, "again")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    strange = labels.unionByName(spark.createDataFrame([(None, 1), (9_001, None), (9_002, 7)], "doc_id long, toxic int"))
    found = toxicity.scored(more, strange).collect()
    assert len(found) == 1_500 + len(odd)
    blank = {r.score for r in found if r.doc_id in (None, 9_001)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert len({r.score for r in found if r.doc_id == 9_003}) == 2


def test_without_texts_or_labels(spark, tables):
    docs, labels = tables
    assert toxicity.scored(docs.limit(0), labels).collect() == []
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.scored(docs.limit(50), none).collect()} == {(0.0, 0)}
    few = toxicity.scored(docs, labels.filter("doc_id < 20")).collect()  # too few to train a dictionary on
    assert len(few) == 1_500 and all(0 <= r.score <= 1 for r in few)

"""The shared dictionary of op 2: left out only where samples are too few, and not without a sign."""

import pytest
import zstandard

from runlens.llm import token_files
from runlens.llm.queries import tokenizer


@pytest.mark.parametrize("texts", [[], ["a"], ["the same text"] * 3])
def test_too_few_samples_are_recorded(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = token_files.write_token_files(docs, tokenizer("byte_bpe_50k.json"), 2)
    row = spark.read.parquet(files.dictionaries).first()
    assert not row.content and row.reason
    assert token_files.read_token_files(spark, files).count() == len(texts)


def test_a_trained_dictionary_has_no_reason(spark):
    docs = spark.createDataFrame([(i, f"{i} and more of {i * i} " * 30) for i in range(300)], "doc_id long, text string")
    row = spark.read.parquet(token_files.write_token_files(docs, tokenizer("byte_bpe_50k.json"), 2).dictionaries).first()
    assert row.content and row.reason is None


@pytest.mark.parametrize("error", [MemoryError(), ValueError("bad"), zstandard.ZstdError("another")])
def test_other_faults_are_not_hidden(spark, monkeypatch, error):
    def fail(*_):
        raise error

    monkeypatch.setattr(zstandard, "train_dictionary", fail)
    docs = spark.createDataFrame([(1, "a", 3)], "doc long, text string, n long").selectExpr("doc", "cast(text AS binary) AS ids")
    with pytest.raises(type(error)):
        token_files.trained(docs)

"""The encoder of ops 2 and 6: right ids of whole texts, and little work per word."""

import random

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm.pieces import PieceEncoder
from runlens.llm.queries import tokenizer
from runlens.llm.token_files import in_larger

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def right(pieces, texts):
    for text, found in zip(texts, pieces.encode(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("name", "blanks"), FILES)
def test_a_word_before_marks_is_encoded_once(name, blanks, monkeypatch):
    pieces, encoded = PieceEncoder(tokenizer(name), blanks), []
    plain = pieces._encoded

    def noted(asked):
        encoded.extend(asked)
        return plain(asked)

    monkeypatch.setattr(pieces, "_encoded", noted)
    right(pieces, ["a ündering ündering, ündering. ündering?! ündering&&&"])
    assert sum("ündering" in x for x in encoded) == 1
    right(pieces, ["a ündering$$$ ündering"])
    assert sum("ündering" in x for x in encoded) == 1


@pytest.mark.parametrize(("name", "blanks"), FILES)
@pytest.mark.parametrize("remembered", [0, 12, 1000])
def test_marks_behind_letters_of_all_kinds(name, blanks, remembered, monkeypatch):
    monkeypatch.setattr("runlens.llm.pieces.GROUP", 200)
    letters = ["a", "İ", "ß", "é", "é", "Σ", "ª", "中", "ǰ", "1", "'s", "_", "'", "<|endoftext|>", "̸"]
    marks = [",", ".", "!", "?", "$$", "#", "&", "%", ":", ";", "*", "=", "(", " ", " ", " ", "\n", "\t", "\x00"]
    rng = random.Random(11)
    texts = ["".join(rng.choice(rng.choice((letters, marks))) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    pieces = PieceEncoder(tokenizer(name), blanks, remembered)
    right(pieces, [*texts, "", *texts, " ", "\n", "a,", "\na,"])
    assert len(pieces.known.pieces) == len(pieces.known.ids) <= remembered


def test_small_batches_are_encoded_together():
    rows = [(i, "x" * (5_000 if i == 70 else 20)) for i in range(100)]
    batches = [pa.record_batch({"doc": [d], "text": [t]}) for d, t in rows]
    found = list(in_larger(iter(batches), 1_000))
    assert [(r["doc"], r["text"]) for b in found for r in b.to_pylist()] == rows
    assert len(found) <= 8 and list(in_larger(iter([]))) == []
    assert all(b.nbytes <= 1_000 or b.num_rows == 1 for b in found)

"""Proximity matches of op 4 against brute force, on a small table and on the given ones."""

import collections
import hashlib
import re

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as registered
from runlens.llm import decontamination

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_items(docs, items, near, window=10):
    """Items by document of which a window has a first place that all its terms stand close to."""
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(name))
    out = []
    for doc, text in docs:
        places = collections.defaultdict(list)
        for i, word in enumerate(words(text)):
            places[word].append(i)
        held = set()
        for terms, names in windows.items():
            if all(t in places for t in terms):
                firsts = {p - k + d for k, t in enumerate(terms) for p in places[t] for d in range(-near, near + 1)}
                if any(all(any(abs(p - f - k) <= near for p in places[t]) for k, t in enumerate(terms)) for f in firsts):
                    held |= names
        out.append((doc, sorted(held)))
    return out


DOCS = [
    (1, "one two extra three four"),
    (2, "one three"),
    (3, "two one x x four three"),  # a first place before the document's own
    (4, "b c a a d filler one four"),
    (5, None),
    (6, "three four one two three and one x x two x three four"),
    (7, "c b a"),
    (8, "b a c " * 3 + "a"),
]
ITEMS = [(1, "one two three four"), (2, "a b c"), (3, "x four"), (4, "absent words"), (5, None)]


@pytest.mark.parametrize("near", [1, 2, 3])
@pytest.mark.parametrize("parts", [1, 3])
def test_near_items(spark, near, parts):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(parts)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.decontaminated(docs, items, near=near).collect()
    assert sorted((r.doc_id, sorted(r.near_items)) for r in found) == near_items(DOCS, ITEMS, near)
    assert all(r.n_near_items == len(r.near_items) and set(r["items"]) <= set(r.near_items) for r in found)


def test_registered_query_shows_near_items(spark):
    docs, items = ([tuple(r.values()) for r in pq.read_table(f"{SF}/{t}.parquet", columns=c).to_pylist()] for t, c in (("documents", ["doc_id", "text"]), ("benchmark", ["item_id", "text"])))
    wanted = sorted((d, len(n), hashlib.sha256(",".join(n).encode()).hexdigest()) for d, n in near_items(docs, items, 2))
    assert any(n for _, n, _ in wanted)
    found = registered.queries()["op4_benchmark_decontamination"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_near_items, r.near_items_sha256) for r in found) == wanted


def test_slack_beyond_the_gap(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    with pytest.raises(ValueError):
        decontamination.decontaminated(docs, docs, near=3_000, item_id="doc_id")


def test_words_whose_letters_add_up_alike_are_told_apart(spark):
    signs = ["ab"[bin(i).count("1") % 2] for i in range(1_024)]
    one, other = "".join(signs), "".join("ba"[c == "b"] for c in signs)
    texts = [(1, f"x {one} y"), (2, f"x {other} y"), (3, "x " + "q" * 64 + "z y"), (4, "12345678 1234567 123456789")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([("i", other), ("j", "q" * 64), ("k", "123456789")], "item_id string, text string")
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.decontaminated(docs, items).collect()}
    assert found == {1: (0, []), 2: (1, ["i"]), 3: (0, []), 4: (1, ["k"])}


def test_items_in_several_sets_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b c d e f g h i j k{i % 3} l") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(n, f"b c d e f g h i j k{n} l") for n in range(3)], "item_id int, text string")
    columns = ["doc_id", "n_hit", "n_items", "items_sha256", "n_near_items"]
    whole = decontamination.decontaminated(docs, items).select(columns).collect()
    monkeypatch.setattr("runlens.llm.decontamination.SET_BYTES", 20)
    assert sorted(decontamination.decontaminated(docs, items).select(columns).collect()) == sorted(whole)

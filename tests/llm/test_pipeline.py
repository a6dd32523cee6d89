"""The pipeline and each of its stages against brute force, on a small hand-made table."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from runlens.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ITEMS = "item_id long, text string"
SYLLABLES = ["".join(p) for p in itertools.product("bdfglmnprst", "aeiou", "lnrs")]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=2)) for _ in range(n))


def hand_made():
    """Rows with exact and near copies, shared passages, junk, nulls, ties, repeated ids and rows."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(100, 160)) for _ in range(12)]
    texts = dict(enumerate(base))
    words = base[0].split()
    words[50] = "changed"
    texts[20] = " ".join(words)  # near copies of document 0, one of the other
    words[0] = "another"
    texts[21] = " ".join(words)
    texts[22] = base[1]  # an exact copy
    passage = " ".join(base[2].split()[20:50])
    texts[30] = prose(rng, 60) + " " + passage + "é" + prose(rng, 60)
    texts[31] = prose(rng, 60) + " " + passage + "è" + prose(rng, 60)  # differs within a character
    texts[32] = prose(rng, 30) + " " + texts[30][-150:] + " " + prose(rng, 30)
    ends = [" ".join(base[i].split()[-35:]) for i in (3, 4)]
    texts[33] = ends[0] + " " + ends[1]  # all of it stands earlier: emptied
    half = prose(rng, 40)
    texts[34] = half + " " + prose(rng, 60) + " " + half  # repeats itself
    texts[35] = "junk " * 80
    texts[36] = "short text"
    texts[37] = base[5] + " " + "#$% " * 60
    texts[38] = ""
    texts[39] = None
    texts[40] = " \n\n "
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    again = prose(rng, 80)
    rows += [(7, again, "de", "x", len(again)), (7, again, "de", "x", len(again)), (None, prose(rng, 70), None, None, None), (None, None, None, None, 5)]
    rng.shuffle(rows)
    items = [(1, " ".join(base[6].upper().split()[30:45])), (2, " ".join(base[8].split()[3:5])), (2, None), (4, "!! ?"), (None, "nowhere seen")]
    return rows, items


ROWS, BENCHMARK = hand_made()
CLEAN = [(i, f"{t}", *rest) for i, t, *rest in ROWS if i is not None and i < 20 and i != 7]


def in_order(rows):
    """As the stages order rows: by id, then by the text columns, nulls first."""
    return sorted(rows, key=lambda r: [(True, v) if v is not None else (False,) for v in (r[0], *r[1:4])])


def good(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w, hit = word.findall(text), set()
    three = list(zip(w, w[1:], w[2:]))
    often = collections.Counter(three)
    for i, t in enumerate(three):
        hit |= {i, i + 1, i + 2} if often[t] > 1 else set()
    lines = [x for x in text.split("\n") if word.search(x)]
    chars = sum(map(len, w))
    return not (
        len(w) < 50
        or 100 * len(hit) > 50 * len(w)
        or 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(w)
        or 2 * (len(lines) - len(set(lines))) > text.count("\n") + 1
        or not 2 * len(w) <= chars <= 15 * len(w)
        or 5 * len(re.findall("[!?]", text)) > len(w)
        or 2 * len(re.findall("[A-Z]", text)) > chars
    )


def brute_quality(rows, items):
    return [r for r in rows if good(r[1])]


def brute_near(rows, items):
    rows = in_order(rows)
    sets = []
    for r in rows:
        w = (r[1] or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        c = len(sets[i] & sets[j])
        if c and 10 * c >= 8 * (len(sets[i]) + len(sets[j]) - c):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def brute_passages(rows, items, length=100):
    seen, out = set(), []
    for r in in_order(rows):
        raw = (r[1] or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen.add(raw[p : p + length])
        kept, at = "", 0
        for char in r[1] or "":  # a character goes if all its bytes do
            n = len(char.encode())
            kept += "" if all(gone[at : at + n]) else char
            at += n
        if raw and not kept:
            continue
        out.append(r if r[1] is None else (r[0], kept, r[2], r[3], len(kept), *r[5:]))
    return out


def brute_free(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for _, text in items:
        w = words(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    out = []
    for r in rows:
        w = words(r[1])
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            out.append(r)
    return out


def check_packed(found, rows):
    """Pieces lie end to end in sequences and hold the ids of each text once."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode
    place, got, wanted = 0, collections.Counter(), collections.Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id, r.offset) == divmod(place, 2048) and r.offset + r.length <= 2048
        place += r.length
        got[(r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32)] += 1
    total, all_ids = 0, collections.defaultdict(list)
    for r in rows:
        ids = np.array([*encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        all_ids[(r[0], len(ids))].append(ids)
        total += len(ids)
    assert place == total
    for doc, n, start, length, crc in got:
        assert any(zlib.crc32(ids[start : start + length].tobytes()) == crc for ids in all_ids[(doc, n)])
    for (doc, n, start, length, _), times in got.items():
        wanted[(doc, n)] += times * length
    assert wanted == {key: key[1] * len(ids) for key, ids in all_ids.items()}


BRUTE = {
    "quality rules": brute_quality,
    "n-gram Jaccard join": brute_near,
    "suffix-array dedup": brute_passages,
    "benchmark decontamination": brute_free,
}


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("tables"), ROWS, BENCHMARK)


def tables(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline(spark, sf_dir):
    rows = ROWS
    assert [name for name, _ in corpus_pipeline.STAGES] == [*BRUTE, "packing"]
    for name, brute in BRUTE.items():
        left = brute(rows, BENCHMARK)
        assert len(left) < len(rows), f"no row of the table tests {name}"
        rows = left
    check_packed(corpus_pipeline.run(spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("name", list(BRUTE))
def test_stage_without_odd_texts(spark, sf_dir, name):
    """Each stage on all rows with a text; those without one have their own test."""
    rows = [r for r in ROWS if r[1]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    assert plain(found.collect()) == plain(BRUTE[name](rows, BENCHMARK))


@pytest.mark.parametrize("name", list(BRUTE))
def test_stage_with_null_and_empty_texts(spark, sf_dir, name):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert plain(found.collect()) == plain(BRUTE[name](ROWS, BENCHMARK))


def test_packing_stage(spark, sf_dir):
    check_packed(corpus_pipeline.sequences(spark, spark.createDataFrame(ROWS, SCHEMA), sf_dir).collect(), ROWS)


def test_no_documents_and_no_items(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.createDataFrame(CLEAN, SCHEMA)
    assert plain(corpus_pipeline.benchmark_free(spark, docs, folder).collect()) == plain(CLEAN)


CLASHING = "row_key string, Kept_text string, kept string, doc string, row string, copy string, text_ string"


@pytest.mark.parametrize("name", list(BRUTE))
def test_stage_keeps_columns_with_names_of_its_own(spark, sf_dir, name):
    more = tuple(f"own {c}" for c in range(len(CLASHING.split(", "))))
    rows = [(*r, *more) for r in ROWS if r[1]]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}").repartition(3)
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert found.dtypes == docs.dtypes
    assert plain(found.collect()) == plain(BRUTE[name](rows, BENCHMARK))

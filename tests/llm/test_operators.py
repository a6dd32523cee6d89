"""Each operator against brute force, on rows with nulls, empty, long, tied and repeated texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from runlens.llm import (
    common,
    decontamination,
    jaccard_join,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    token_files,
    url_filters,
)
from runlens.llm.pieces import PieceEncoder
from runlens.llm.queries import URL_RULES, tokenizer

WORDS = "the of and was thing other ünder straße reading over again much more 12 345 End. line".split()


def texts(n=80, seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n // 2)]
    near = []
    for text in base[:20]:
        words = (text + " " + base[-1]).split()
        words[rng.randrange(len(words))] = "changed"
        near += [text + " " + base[-1], " ".join(words)]
    odd = ["", " ", "a", "a  b", "\n\nx \n", "é" * 300, "ab" * 400, "<|endoftext|> in a text", "!! ?? ##", base[0], base[0]]
    return base + near + odd + [" ".join(rng.choices(WORDS, k=6_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "n_words") for i, t in enumerate(texts())]
    rows += [(500, None, None, None), (None, "a row without an id", "x", "y"), (3, rows[3][1], "en", "again"), (4, "other text, same id", "", "")]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words string").repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def same(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def ids(name, text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokenizer(name)).encode(text, add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, blanks, monkeypatch):
    monkeypatch.setattr("runlens.llm.pieces.GROUP", 300)
    rng, marks = random.Random(5), [" ", "\n", "\t", "a", "B", "'s", "é", "1", "!", " ", "<|endoftext|>", "  ", "中", "\x1c"]
    odd = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(400)] + texts()
    pieces = PieceEncoder(tokenizer(name), blanks, remembered=40)
    for text, found in zip(odd, pieces.encode(odd)):
        assert np.frombuffer(found, "<u4").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids


def test_near_duplicates(docs, rows, monkeypatch):
    for paired in (32, 1):
        monkeypatch.setattr(jaccard_join, "PAIRED", paired)
        monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 3)
        sets = []
        for _, text in rows:
            w = text.split()
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        n, root = len(rows), list(range(len(rows)))
        links = [0] * n

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(n):
            for j in range(i):
                c = len(sets[i] & sets[j])
                if c and 10 * c >= 8 * (len(sets[i]) + len(sets[j]) - c):
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        wanted = [(rows[i][0], rows[find(i)][0], links[i]) for i in range(n)]
        same([(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()], wanted)


def test_token_files(spark, docs, rows):
    files = token_files.write_token_files(docs, tokenizer("byte_bpe_50k.json"), 2)
    at, wanted = 0, collections.defaultdict(list)
    encoded = {i: ids("byte_bpe_50k.json", text, 2) for i, (_, text) in enumerate(rows)}
    found = token_files.read_token_files(spark, files).orderBy("start").collect()
    for i, (doc, _) in enumerate(rows):
        wanted[doc].append(encoded[i].tolist())
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found], [(d, len(e), zlib.crc32(e.tobytes())) for (d, _), e in zip(rows, encoded.values())])
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in found] == [d for d, _ in rows]
    for doc in (7, 4):
        same(token_files.read_document(spark, files, doc), wanted[doc])


def test_sharding(docs, rows):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    # Brute force: every shard's whole order, taken in turns.
    orders = {}
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % 101, int.from_bytes(d[8:16], "big") % 100 + 1
        orders[name] = iter([(offset + j * skip) % 101 for j in range(101)])
    owner = {}
    while len(owner) < 101:
        for name in sorted(shards):
            free = next((s for s in orders[name] if s not in owner), None)
            if free is not None:
                owner[free] = name
    assert [shards[i] for i in table] == [owner[s] for s in range(101)]
    assert max(collections.Counter(table).values()) - min(collections.Counter(table).values()) <= 1
    slot = lambda d: int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:15], 16) % 101
    found = sharding.placed_on_shards(docs, shards, 101)
    same(map(tuple, found.collect()), [(d, slot(d), owner[slot(d)]) for d, _ in rows])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 101)


def test_decontamination(spark, docs, rows, monkeypatch):
    items = [(1, rows[60][1]), (2, "the of"), (3, None), (4, "!!"), (2, "the of"), (9, " ".join(rows[50][1].upper().split()[:15]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = collections.defaultdict(set)
    for name, text in items:
        w = pattern.findall(low(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(name))
    wanted = []
    for doc, text in rows:
        w, hit, names = pattern.findall(low(text)), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        wanted.append((doc, len(w), len(hit), len(names), digest, bool(hit)))
    for size in (8_000_000, 40):  # all items at once, and in several sets
        monkeypatch.setattr(decontamination, "SET_BYTES", size)
        same([tuple(r)[:6] for r in decontamination.decontaminated(docs, frame).collect()], wanted)


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "one two extra three four"), (2, "one three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    found = {r.doc_id: (r.n_items, r.n_near_items) for r in decontamination.decontaminated(docs, items, near=1).collect()}
    assert found == {1: (0, 1), 2: (0, 0)}


def test_quality_rules(docs, rows):
    word, wanted = re.compile(r"[^\x20\x09-\x0D]+"), []
    for doc, text in rows:
        w, hit = word.findall(text), set()
        three = list(zip(w, w[1:], w[2:]))
        often = collections.Counter(three)
        for i, t in enumerate(three):
            if often[t] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if word.search(x)]
        chars, symbols, again = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        broken = (
            10 * symbols > len(w)
            or 2 * again > text.count("\n") + 1
            or not 2 * len(w) <= chars <= 15 * len(w)
            or 5 * len(re.findall("[!?]", text)) > len(w)
            or 2 * len(re.findall("[A-Z]", text)) > chars
        )
        wanted.append((doc, len(w), chars, symbols, again, len(hit), failed, not failed and not broken))
    found = quality_rules.judged(docs)
    same(map(tuple, found.collect()), wanted)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert quality_rules.passing(docs).columns == docs.columns
    assert quality_rules.passing(docs).count() == sum(w[-1] for w in wanted)


def test_packing(docs, rows):
    found = packing.packed(docs, tokenizer("word_bpe_49k.json"), 1, length=64, with_ids=True).collect()
    by_doc = collections.defaultdict(list)
    place = 0
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id, r.offset) == divmod(place, 64)
        assert r.offset + r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32
        place += r.length
        if r.start == 0:
            by_doc[r.doc_id].append(b"")
        by_doc[r.doc_id][-1] += bytes(r.ids)
    wanted = collections.defaultdict(list)
    for doc, text in rows:
        wanted[doc].append(ids("word_bpe_49k.json", text, 1).tobytes())
    assert {d: sorted(x) for d, x in by_doc.items()} == {d: sorted(x) for d, x in wanted.items()}


def brute_dedup(rows, length=100):
    seen, out = set(), []
    for doc, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, rows, monkeypatch):
    wanted = brute_dedup(rows)
    for crowded, piece in ((2_000, 1_000_000), (1, 700)):
        monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        same(map(tuple, suffix_dedup.deduplicated(docs).collect()), wanted)
    kept = suffix_dedup.deduplicated(docs, with_kept=True, whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in kept)


def test_token_counts(docs, rows, tmp_path):
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")).encode
    wanted = [(d, len(t.encode()), len(encode(t)), len(encode(t)) > 50) for d, t in rows]
    cache = str(tmp_path / "cache")
    for _ in range(2):
        same(map(tuple, token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model"), cache, limit=50).collect()), wanted)
    assert token_counts.read_cache(docs.sparkSession, cache).count() == len({t for _, t in rows})


def test_token_counts_of_many_copies(spark, tmp_path):
    rows = [(None if i % 3 else i, "one text that has many copies", "x") for i in range(2_500)] + [(1, "another", "y"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string")
    found = [tuple(r) for r in token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model"), str(tmp_path / "c")).collect()]
    encode = token_counts.processor(tokenizer("piece_bpe_32k.model")).encode
    same(found, [(d, len((t or "").encode()), len(encode(t or "")), False) for d, t, _ in rows])


def test_the_token_count_query_encodes_nothing_twice(spark, monkeypatch, tmp_path):
    from runlens.llm import queries

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.runlens.tokenCache", str(tmp_path / "cache"))
    first = sorted(map(tuple, queries.QUERIES["op8_token_counts"](spark, sf).collect()))
    encoded = []
    counted = token_counts.counted
    monkeypatch.setattr(token_counts, "counted", lambda misses, model: encoded.append(misses.count()) or counted(misses, model))
    try:
        assert sorted(map(tuple, queries.QUERIES["op8_token_counts"](spark, sf).collect())) == first
        assert encoded == [0]
    finally:
        spark.conf.unset("spark.runlens.tokenCache")
    assert sorted(map(tuple, queries.QUERIES["op8_token_counts"](spark, sf).collect())) == first
    assert encoded[1] > 0


def test_url_filters(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://A.b.net:80?x", ""),
            (2, "https://q.org/1", '<link href="http://w.net/1" rel=canonical>'),
            (3, "http://w.net/1", None),
            (4, None, "x"),
            (5, "nonsense", ""),
            (6, "http://r.com/a", '<meta http-equiv="refresh" content="0; url=http://s.com/b">'),
            (7, "http://s.com/b", "<LINK rel='canonical' href='http://x.example.com/de/1'>"),
            (8, "https://q.org/2", '<link rel="canonical" href="http://w.net/1"><link rel="canonical" href="http://a.org/fr/">'),
            (9, "http://net.example.net/en/x#y", ""),
            (9, "http://net.example.net/en/x#y", ""),
            (None, "http://notexample.com/de/", ""),
        ],
        "page_id long, url string, html string",
    )
    found = [tuple(r)[:5] for r in url_filters.judged(pages, url_filters.rules_from(URL_RULES)).collect()]
    same(
        found,
        [
            (1, "a.b.net:80", "", None, "allow"),
            (2, "q.org", "/1", None, "allow"),  # an alias is allowed by a rule
            (3, "w.net", "/1", "net/", "block"),
            (4, "", "", None, "allow"),
            (5, "", "", None, "allow"),
            (6, "r.com", "/a", None, "block"),
            (7, "s.com", "/b", None, "block"),
            (8, "q.org", "/2", None, "allow"),
            *[(9, "net.example.net", "/en/x", "example.net/en/", "allow")] * 2,
            (None, "notexample.com", "/de/", None, "allow"),
        ],
    )


def test_classifier_tells_held_out_documents_apart(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(WORDS if i % 4 else ["junk", "spam", "buy", "the"], k=80))) for i in range(400)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)]
    frame = spark.createDataFrame([*docs, (999, None)], "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_classifier, "FEW_ROWS", 20)
    found = quality_classifier.resampled(frame, given).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert len(found) == 401 and len(kept) == 301
    held_out = [i for i in range(200, 400)]
    assert sum((i in kept) == (i % 4 > 0) for i in held_out) >= 0.95 * len(held_out)
    order = sorted(found, key=lambda r: (-r.key, r.doc_id))
    assert kept == {r.doc_id for r in order[:301]}
    assert all(r.kept for r in quality_classifier.resampled(frame, given.limit(0)).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)] + [(200, i) for i in range(201, 260)]
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 260)}}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    files = token_files.write_token_files(none, tokenizer("byte_bpe_50k.json"), 2)
    for frame in (
        jaccard_join.near_duplicates(none),
        token_files.read_token_files(spark, files),
        sharding.placed_on_shards(none, ["a"], 3),
        decontamination.decontaminated(none, items),
        quality_rules.judged(none),
        packing.packed(none, tokenizer("word_bpe_49k.json"), 1),
        suffix_dedup.deduplicated(none),
        token_counts.token_counts(none, tokenizer("piece_bpe_32k.model"), str(tmp_path / "c")),
        url_filters.judged(pages, []),
        quality_classifier.resampled(none, labels),
    ):
        assert frame.count() == 0

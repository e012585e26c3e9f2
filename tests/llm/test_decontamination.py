import hashlib
import random
import re

import numpy as np

from palimpsest.llm import decontamination
from palimpsest.llm.decontamination import FMIndex, clean, decontaminate, digest

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width):
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (own := phrases.get(tuple(w[i : i + n]))) is not None:
                    found |= own
                    hit[i : i + n] = [1] * n
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), sum(hit), len(found), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "Ab", "aB", "x"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 14, 20, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "--"), (103, items[3][1]), (9, items[4][1].upper())]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(r.randrange(5)):
            parts.append(r.choice(items)[1] or "" if r.random() < 0.5 else " ".join(r.choice(vocabulary) for _ in range(r.randrange(40))))
        docs.append((d, r.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(200, None), (201, ""), (202, "..."), docs[5]], items


def test_against_brute_force(spark, monkeypatch):
    for seed, width, most in ((1, 13, 10**6), (2, 4, 10**6), (3, 13, 40)):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", most)
        docs, items = corpus(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        assert sorted(map(tuple, digest(d, b, width).collect())) == brute(docs, items, width)
        left = {r.doc_id for r in clean(d, b, width).collect()}
        assert left == {x[0] for x in brute(docs, items, width) if not x[5]}


def test_spans(spark):
    d = spark.createDataFrame([(1, "q a b c a b c q", "x")], "doc_id long, text string, items string")
    b = spark.createDataFrame([(7, "A b"), (8, "b C")], "item_id long, text string")
    row = decontaminate(d, b).first()
    assert (row.n_hit, row["items"], [tuple(x) for x in row.spans]) == (6, ["7", "8"], [(1, 7)])


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    docs, items = corpus(5)
    docs += [(None, items[0][1]), (None, items[0][1]), (None, "q"), docs[7]]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = [rows(f(d, b)) for f in (decontaminate, digest, clean)]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    assert [rows(f(d, b)) for f in (decontaminate, digest, clean)] == whole


def test_columns_of_any_name_stay(spark, monkeypatch):
    names = ["row", "version", "n_hit", "items", "spans", "n_words", "of", "at", "a.b"]
    docs = [(1, "one two three", *names), (2, "other words", *names), (None, None, *[None] * len(names)), (2, "other words", *names)]
    d = spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    b = spark.createDataFrame([(1, "one two three"), (2, "four five")], "item_id long, text string")
    for most in (10**6, 1):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", most)
        got = clean(d, b)
        assert got.schema == d.schema and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, docs[1:]))


def test_documents_without_words_come_first(spark):
    item, short = " ".join(f"w{i}" for i in range(13)), "v0 v1"
    items = [(1, item), (2, short)]
    for before in ([None], [""], ["-- ."], [None, "", "..."]):
        for own in (item, short, item + " and more", short + " v0 v1"):
            docs = [*enumerate(before), (9, own), (10, item)]
            d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
            b = spark.createDataFrame(items, "item_id long, text string")
            assert sorted(map(tuple, digest(d, b).collect())) == brute(docs, items, 13)
            assert {r.doc_id for r in clean(d, b).collect()} == {k for k, _ in enumerate(before)}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.n_items, r.contaminated) for r in digest(d, b).collect()] == [(0, 0, False)]
    assert digest(d.limit(0), b).collect() == []


def test_index_counts_and_positions():
    r = np.random.default_rng(4)
    for _ in range(30):
        parts = [r.integers(1, 4, r.integers(1, 30)) for _ in range(5)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        index = FMIndex(text, 4)
        phrase = r.integers(1, 4, (6, 3))
        low, high = index.search(phrase)
        for p, a, b in zip(phrase, low, high):
            expected = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected

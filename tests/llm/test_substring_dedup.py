import hashlib
import random
from collections import Counter

import palimpsest.llm.substring_dedup as module
from palimpsest.llm.substring_dedup import digest, substring_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    words = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "b", "the", "é", "x y"] + [f"w{i}" for i in range(40)]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([5, 12, 20, 60]))] for _ in range(6)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(r.randrange(0, 6)):
            words += r.choice(passages) if r.random() < 0.4 else [r.choice(vocabulary) for _ in range(r.randrange(0, 40))]
        rows.append((d, "".join(w + r.choice([" ", "\n", "\t ", "\x0b"]) for w in words)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a " * 50), (n + 3, "a b " * 40), (n + 4, "a b c " * 30 + "d")]
    rows += [(n + 5 + i, rows[i][1]) for i in range(5)] + [rows[0]]
    return rows


def test_against_brute_force(spark):
    for seed, window in ((1, 35), (2, 10), (3, 3)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert sorted(map(tuple, digest(df, window).collect())) == brute(rows, window)


def test_groups_of_chunks_give_the_same(spark, monkeypatch):
    rows = corpus(4, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    monkeypatch.setattr(module, "CHUNK_BYTES", 600)
    for group in (1, 3, 1000):
        monkeypatch.setattr(module, "GROUP", group)
        assert sorted(map(tuple, digest(df, 10).collect())) == brute(rows, 10)


def test_extra_columns_and_text(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(40)), "z"), (2, "begin " + " ".join(f"w{i}" for i in range(40)) + " end", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk_id string")
    got = {r.doc_id: (r.n_removed, r.text) for r in substring_dedup(df).collect()}
    assert got == {1: (40, ""), 2: (40, "begin end")}


def test_empty_table(spark):
    assert digest(spark.createDataFrame([], SCHEMA)).collect() == []

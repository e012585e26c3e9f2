import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import simhash
from palimpsest.llm.simhash import allocate, components, links, near_duplicates, one_of_each
from palimpsest.llm.shared import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = [w.decode() for w in (text or "").translate(LOWER).encode().split()]
    parts = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(values, distance=3):
    """Least key of each key's component; values: key -> fingerprint."""
    root = {k: k for k in values}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (values[a] ^ values[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Big", "a"]
    rows = []
    for d in range(n):
        if rows and r.random() < 0.6:
            own = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = r.choice(words)
        else:
            own = [r.choice(words) for _ in range(r.choice([1, 2, 3, 80, 300]))]
        rows.append((d, " ".join(own)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "A  b\t\tC\n"), (n + 4, "a b c"), (n + 5, "one"), (n + 6, "two words "), rows[3]]


def test_against_brute_force(spark):
    rows = corpus(1)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    prints = {d: fingerprint(t) for d, t in rows}
    assert len(got) == len(rows)
    assert {x.doc_id: int(x.fingerprint, 16) for x in got} == prints
    assert {x.doc_id: x.component_id for x in got} == groups(prints)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_dense_groups(spark, bucket):
    """Chains and clouds of near fingerprints, in buckets that have to be split."""
    r = random.Random(9)
    values, x = set(), r.getrandbits(64)
    for _ in range(150):
        for _ in range(r.choice([2, 3, 4])):
            x ^= 1 << r.randrange(64)
        values.add(x)
    hub = r.getrandbits(64)
    for _ in range(200):
        values.add(hub ^ (1 << r.randrange(8)) ^ (1 << r.randrange(40, 48)) ^ (1 << r.randrange(64)))
    values = dict(enumerate(sorted(values)))
    distinct = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in values.items()], "rep long, fingerprint long")
    found = components(links(written(distinct, "test"), 3, bucket=bucket))
    named = {k: k for k in values} | {r.node: r.component for r in found.collect()}
    assert named == groups(values)


@pytest.mark.parametrize("chosen", [[-1, 1, 0, 0], [-1, 2, -1, 0], [3, -1, -1, -1]])
def test_split_of_near_values(spark, monkeypatch, chosen):
    """Isolated pairs that differ inside a partition of threshold 1 or more, in buckets that have to be split."""
    monkeypatch.setattr(simhash, "group_bits", lambda *_: [list(range(k, k + 16)) for k in (0, 16, 32, 48)])
    monkeypatch.setattr(simhash, "thresholds", lambda *_: chosen)
    r, values = random.Random(6), []
    for a in [(16, 32, 48), (0, 16, 32), (16, 17, 48), (0, 1, 2), (0, 16, 48)]:
        x = r.getrandbits(64)
        values += [x, x ^ sum(1 << b + 5 for b in a)]
    values = {k: v for k, v in enumerate(values)}
    distinct = spark.createDataFrame([(k, simhash.signed(v)) for k, v in values.items()], "rep long, fingerprint long")
    found = components(links(written(distinct, "test"), 3, bucket=1))
    assert {k: k for k in values} | {x.node: x.component for x in found.collect()} == groups(values)


def test_allocation_is_best():
    from itertools import product

    r = random.Random(2)
    for _ in range(50):
        costs = [[0, *sorted(r.randrange(100) for _ in range(4))] for _ in range(4)]
        best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in product(range(-1, 4), repeat=4) if sum(ts) == 0)
        assert sum(c[t + 1] for c, t in zip(costs, allocate(costs, 0))) == best


def test_correlated_bits_stay_together():
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (2000, 64))
    for k in range(1, 16):
        bits[:, k * 4] = bits[:, 0]
    groups = simhash.group_bits(2000, (bits.T @ bits).astype(float))
    assert [k * 4 for k in range(16)] in groups and sorted(sum(groups, [])) == list(range(64))


def test_one_of_each_and_empty(spark):
    rows = [(5, "a b c d", "x"), (2, "A b c d", "y"), (9, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == [2, 9]
    assert one_of_each(df.limit(0)).collect() == []


def test_null_and_repeated_ids(spark):
    """A document without doc_id stands only for groups that have no other; of repeated rows one stays."""
    rows = [(None, "one text of its own", "p"), (None, "x y z w", "q"), (7, "X Y z w", "r"), (7, "X Y z w", "r"), (7, "another thing with other words", "s"), (3, None, "t"), (3, "", "u"), (None, None, "v")]
    names = ["row", "version", "id", "number", "null_id", "component", "copies"]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string")
    for n in names:
        df = df.withColumn(n, F.lit(n))
    got = one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == [(0, "one text of its own"), (3, ""), (7, "X Y z w"), (7, "another thing with other words")]
    made = near_duplicates(df).collect()
    assert len(made) == len(rows) and sorted(str(r.component_id) for r in made) == ["3", "3", "3", "7", "7", "7", "7", "None"]


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "the same text everywhere" if i % 3 else f"text {i} of its own {i * i} words {i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = groups({d: fingerprint(t) for d, t in rows})
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == expected
    assert {r.doc_id for r in one_of_each(df).collect()} == set(expected.values())

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import palimpsest.llm.line_dedup as line_dedup_module
from palimpsest.llm.line_dedup import Runs, digest, line_dedup
from palimpsest.llm.shared import SortedBuckets, split_join

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=40, documents=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders, keeper = defaultdict(int), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holders[k] += 1
                keeper[k] = max(keeper.get(k, d), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (holders.get(key(x), 0) >= documents and keeper[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=70):
    r = random.Random(seed)
    lines = [" ".join(r.choice(["Alpha", "É", "beta", "x"]) for _ in range(r.choice([3, 12, 15]))) + str(i) for i in range(25)]
    rows = []
    for d in range(n):
        own = [r.choice(lines) if r.random() < 0.7 else str(r.random()) * 4 for _ in range(r.randrange(8))]
        own = [r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.3 else x) + r.choice(["", "\r", "\x0b"]) for x in own]
        rows.append((d * 3, "\n".join(own) + r.choice(["", "\n"])))
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, (lines[0] + "\n") * 300)]


@pytest.mark.parametrize("seed,batches,fanout", [(1, 6, 3), (2, 9, 2), (3, 1, 3)])
def test_against_brute_force(spark, seed, batches, fanout):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, digest(df, batches=batches, fanout=fanout).collect())) == brute(rows)


def test_repeated_rows_and_columns(spark):
    line = "the same line of more than forty characters, here"
    rows = [(i, f"{line}\nown {i}", i, "k") for i in range(5)] * 2 + [(None, line, 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, k1 string")
    got = line_dedup(df)
    assert got.columns == df.columns and got.count() == 11
    assert {(r.doc_id, r.text, r.n_chars) for r in got.collect()} == {(i, f"own {i}", 5) for i in range(4)} | {(4, f"{line}\nown 4", len(line) + 6), (None, "", 0)}


def test_columns_of_any_name_stay(spark):
    line = "the same line of more than forty characters, here"
    names = ["k1", "_lines", "_drop", "_of", "deduplicated", "row", "drop", "lines", "version", "keeper", "batch", "a.b", "known"]
    rows = [(i, f"{line}\nown {i}", *[f"{n}{i}" for n in names]) for i in range(6)] + [(None, None, *[None] * len(names)), (None, "", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = line_dedup(df)
    assert got.schema == df.schema
    expected = [(i, f"{line}\nown 5" if i == 5 else f"own {i}", *r[2:]) for i, r in enumerate(rows[:6])] + rows[6:]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_keys_stand_in_one_run_alone(spark):
    """The keeper comes from the anti-join: a key that a run holds is only tallied."""
    batch = "k1 long, k2 long, keeper long, documents long, places long"
    with Runs(spark, 2) as runs:
        for first in (30, 20, 10):
            runs.add(spark.createDataFrame([(k, k, first + k, 1, 2) for k in range(0, first)], batch))
        stored = [r.k1 for run in runs.all() for r in run.collect()]
        counted = {r.k1: (r.keeper, r.documents, r.places) for r in runs.counted().collect()}
    assert sorted(stored) == list(range(30))
    assert counted == {k: (30 + k, n := 1 + (k < 20) + (k < 10), 2 * n) for k in range(30)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run0_")]


def test_cleanup_leaves_nothing(spark):
    from pathlib import Path

    from palimpsest.llm import shared, substring_dedup

    df = spark.createDataFrame(corpus(1)[:9], SCHEMA)
    assert substring_dedup.digest(df).count() == digest(df).count() == 9
    folder = Path(shared.own_folder(spark).removeprefix("file://"))
    assert any(folder.iterdir()) and any(t.name.startswith("chunks_") for t in spark.catalog.listTables())
    shared.cleanup(spark)
    assert not folder.exists() and not any(t.name.startswith("chunks_") for t in spark.catalog.listTables())


def test_runs_are_merged_without_a_shuffle_of_their_own(spark):
    batch = spark.createDataFrame([(k, k, k, 1, 1) for k in range(99)], "k1 long, k2 long, keeper long, documents long, places long")
    with Runs(spark, 9) as runs:
        runs.add(batch.groupBy("k1", "k2").agg(*[F.max(c).alias(c) for c in batch.columns[2:]]))
        own = batch.groupBy("k1", "k2").agg(F.max("keeper").alias("keeper"))
        spark.conf.set(SortedBuckets.ORDERED, "true")
        plan = own.join(runs.all()[0].select("k1", "k2").hint("merge"), ["k1", "k2"], "left")._jdf.queryExecution().executedPlan().toString()
        spark.conf.set(SortedBuckets.ORDERED, "false")
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_hot_and_other_keys(spark, monkeypatch):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for share in (1, 10, 1 << 40):
        monkeypatch.setattr(line_dedup_module, "split_join", lambda *a, share=share: split_join(*a, share=share))
        assert sorted(map(tuple, digest(df).collect())) == brute(rows)


def test_empty_table(spark):
    assert digest(spark.createDataFrame([], SCHEMA)).collect() == []

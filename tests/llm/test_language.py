import zlib

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm.language import DIMENSIONS, digest, has_letter, presence
from palimpsest.llm.words import buffers, mix

import pyarrow as pa


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_presence_against_brute_force():
    texts = ["Ab é", "", "a", "abcabc"]
    raw, at = buffers(pa.array(texts))
    bits = presence(raw, at)
    for row, text in zip(bits, texts):
        b = text.encode().lower()
        grams = {(n, b[i : i + n]) for n in (1, 2, 3) for i in range(len(b) - n + 1)}
        places = {int(mix(np.array([int.from_bytes(g, "big") + (n << 56)], np.uint64))[0]) >> 49 for n, g in grams}
        assert set(np.flatnonzero(row).tolist()) == places and row.shape == (DIMENSIONS,)


def test_letters_and_nulls(spark):
    assert has_letter(*buffers(pa.array(["1", "é", "", "x", "漢", "²!"]))).tolist() == [False, True, False, True, True, False]
    rows = [(i, t, l, 1) for i, (t, l) in enumerate([("the house and the dog", "en"), ("das Haus und der Hund", "de")] * 20)]
    rows += [(100, None, "en", 1), (101, "123 !", None, 1), (102, "the dog and the house", None, 1)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()}
    assert got[100] == got[101] == ("und", 0) and got[102][0] == "en" and len(got) == 43


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in digest(df).collect()] == ["und"]
    assert digest(df.filter(F.lit(False))).collect() == []


def test_null_ids_are_held_out(spark):
    df = spark.createDataFrame([(None, "some words here", "en"), (4, None, None)], "doc_id long, text string, lang string").withColumn("held_out", F.lit("x")).withColumn("order", F.lit(1))
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in digest(df).collect()}
    assert got[None][0] is True and got[4][1] == "und"

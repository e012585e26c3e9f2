"""Each stage against brute force on what the stage before it kept."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontamination, test_line_dedup, test_quality, test_simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append({r.doc_id: r.text for r in docs.collect()})
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
    start, good, lines, apart, clean = kept

    assert all(start[d] == t for d, t in good.items())
    assert not any(test_quality.brute(t)[-1] for t in good.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passing = [d for d, t in start.items() if labels.get(d) == 1 and not test_quality.brute(t)[-1]]
    assert all(d in good for d in passing)

    rows = test_line_dedup.brute(list(good.items()))
    import hashlib

    assert {(d, h) for d, _, _, h in rows} == {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in lines.items()}

    groups = test_simhash.groups({d: test_simhash.fingerprint(t) for d, t in lines.items()})
    assert apart == {d: t for d, t in lines.items() if groups[d] == d}

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = test_decontamination.brute(list(apart.items()), items, 13)
    assert clean == {r[0]: apart[r[0]] for r in judged if not r[-1]}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == clean.keys()
    for d, own in pieces.items():
        ids = np.array(tokenizer.encode(clean[d], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, empty and long texts, clashing names, and no rows at all."""
    good = "It was late in the day when the small boat came back to the harbour, and all the people of the village stood on the old wall to see who had been saved from the storm that night."
    names = ["row", "version", "drop", "lines", "first", "component", "deduplicated", "n_words", "k1", "a.b", "words"]
    own = lambda i: [f"{n}{i}" for n in names]
    rows = [(1, good, "en", None, 5, *own(1)), (1, good, "en", None, 5, *own(1)), (None, good.replace("It was", "it was"), None, None, None, *own(2)), (None, None, None, None, None, *[None] * len(names)), (4, "", "x", "y", 0, *own(4))]
    rows += [(5, " ".join(f"the w{i} of a" for i in range(30_000)), "en", "s", 9, *own(5)), (6, "z" * 50_000, "en", "s", 9, *own(6))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    for k, df in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        docs = df
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}-{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{n}"))
            assert n == 4 or docs.columns == df.columns
            if k == 0 and n == 3:
                # Near copies leave the one with an id; the repeated row goes too.
                assert sorted((r.doc_id, r.row) for r in docs.collect()) == [(1, "row1"), (5, "row5")]
        assert (docs.count() == 0) == (k == 1)

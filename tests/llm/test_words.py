import random
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from palimpsest.llm import decontamination, packing, substring_dedup
from palimpsest.llm.words import NOT_SPACE, Spans, U, buffers, hashes, same_bytes, scan
from tests.llm.test_substring_dedup import brute

SCHEMA = "doc_id long, text string"


def thue_morse(n, a="a", b="b"):
    """A word over two letters; it and its complement have equal polynomials modulo 2**64 from 1,024 letters on."""
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (64, 128, 256, 512, 1024, 2048, 4096)]


def test_equal_words_have_equal_hashes_and_others_not():
    r = random.Random(2)
    words = ["a" * n for n in range(1, 40)] + ["".join(r.choice("abé\x00") for _ in range(r.choice([1, 7, 8, 9, 255, 256, 257, 300]))) for _ in range(300)]
    words += [w for pair in PAIRS for w in pair]
    text = pa.array([" ".join(words), " ".join(reversed(words))])
    raw, at = buffers(text)
    starts, ends, _ = scan(raw, at, NOT_SPACE)
    found = hashes(raw, starts, ends).tolist()
    own = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(found)) == len(set(own)) == len(set(zip(own, found)))
    others = np.array([r.randrange(len(own)) for _ in own])
    others[::3] = len(own) - 1 - np.arange(len(own))[::3]
    assert same_bytes(raw, starts, ends, others).tolist() == [own[i] == own[j] for i, j in enumerate(others)]


def test_spans_tell_runs():
    r = random.Random(4)
    symbols = np.array([r.randrange(3) for _ in range(3000)], U)
    spans = Spans(symbols, 35)
    for size in (1, 2, 3, 16, 31, 32, 35):
        start = np.arange(len(symbols) - size)
        got = spans(start, start + size).tolist()
        runs = [tuple(symbols[a : a + size].tolist()) for a in start]
        assert len(set(got)) == len(set(runs)) == len(set(zip(runs, got)))


def test_packing_keeps_words_apart_whose_hashes_are_forced_equal(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"{a} and {b}" for a, b in PAIRS]
    expected = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    for forced in (False, True):
        if forced:
            monkeypatch.setattr(packing, "hashes", lambda raw, starts, ends: (ends - starts).astype(U))
        ids, at = packing.Words(path).ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in pairwise(at.tolist())] == expected


def test_long_words_in_substring_dedup_and_decontamination(spark):
    rows, items = [], []
    for i, (a, b) in enumerate(PAIRS):
        before, after = " ".join(f"p{i}x{k}" for k in range(20)), " ".join(f"q{i}x{k}" for k in range(20))
        rows += [(3 * i, f"{before} {a} {after}"), (3 * i + 1, f"{before} {b} {after}"), (3 * i + 2, f"{before} {a} {after}")]
        items.append((str(i), f"{before} {a} {after}"))
    # Words in the order of a Thue-Morse word and of its complement.
    order = [" ".join(thue_morse(512)), " ".join(thue_morse(512, "b", "a"))]
    rows += [(100, order[0]), (101, order[1])]
    documents = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, substring_dedup.digest(documents).collect())) == brute(rows, 35)
    found = decontamination.digest(documents, spark.createDataFrame(items, "item_id string, text string"))
    hit = {r.doc_id: r.n_hit for r in found.collect()}
    assert [hit[d] for d in range(len(PAIRS) * 3)] == [41 if d % 3 != 1 else 40 for d in range(len(PAIRS) * 3)]
    assert hit[100] == hit[101] == 0

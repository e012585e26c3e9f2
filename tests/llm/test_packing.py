import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from palimpsest.llm import packing
from palimpsest.llm.packing import best_cuts, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def brute(positions, penalties, length):
    best = [0.0] + [float("inf")] * (len(positions) - 1)
    for i in range(1, len(positions)):
        for j in range(i):
            if positions[i] - positions[j] <= length:
                best[i] = min(best[i], best[j] + length - (positions[i] - positions[j]) + penalties[i])
    return best


def test_queue_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        positions = sorted(r.sample(range(1, 200), r.randrange(1, 40)))
        positions = [0, *positions]
        penalties = [r.randrange(5) for _ in positions]
        assert best_cuts(positions, penalties, 30)[0] == brute(positions, penalties, 30)


def test_round_trip(spark):
    r = random.Random(5)
    words = ["Hello", "world.", "don't", "naïve", "éa", "x1y2", "<|endoftext|>", "Q!", "a-b", "Σας", " z", "é", "...", "漢字", "É×Ü÷ß", "it's", "É.É", "a1é2!!??", "e\u0301x", "Ã\x97", "ÀÉÎÕÜÝÞ", "x\u00adY", "ﬁn", "İ", "#$%^&*"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 50, 700])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "word " * 9000), (104, "long" * 3000), (105, "a\x0bb\x85c d\x1ce")]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    pieces, sequences = {}, {}
    for x in got:
        assert x.doc_tokens == len(expected[x.doc_id]) and x.length == len(x.ids) > 0
        pieces.setdefault(x.doc_id, []).append((x.start, x.ids))
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for d, ids in expected.items():
        assert [i for _, part in sorted(pieces[d]) for i in part] == ids
        assert [s for s, _ in sorted(pieces[d])] == list(np.cumsum([0] + [len(p) for _, p in sorted(pieces[d])])[:-1])
    padding = total = 0
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts))
        size = sum(n for _, n in parts)
        assert size <= 2048
        total += size
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding < 0.02 * total
    digests = {(x.doc_id, x.start): x.ids_crc32 for x in pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, digest=True).collect()}
    for x in got:
        assert digests.get((x.doc_id, x.start), zlib.crc32(np.array(x.ids, "<u4").tobytes())) == zlib.crc32(np.array(x.ids, "<u4").tobytes())


def test_repeated_and_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    got = pack(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string").coalesce(1), PATH, digest=True).collect()
    assert sorted((x.start, x.length, x.offset) for x in got) == [(0, 2, 0), (0, 2, 2)]


def test_known_pieces_are_forgotten_and_met_again(monkeypatch):
    """Ids stay right when few pieces can be kept, and the arrays stay small."""
    r = random.Random(8)
    monkeypatch.setattr(packing, "KNOWN", 40)
    words, tokenizer = packing.Words(PATH), Tokenizer.from_file(PATH)
    vocabulary = ["".join(r.choice("abcdé12!<") for _ in range(r.choice([1, 3, 9, 80]))) for _ in range(60)]
    for _ in range(60):
        texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(12))) for _ in range(3)]
        ids, at = words.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in pairwise(at.tolist())] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        known = words.known
        assert len(known.hash) == len(known.met) == len(known.text_n) == len(known.ids_n) <= 40 + 36
        assert (np.diff(known.hash.astype(object)) > 0).all() and known.text_n.sum() == len(known.text) and known.ids_n.sum() == len(known.ids)

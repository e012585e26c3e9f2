"""Order-preserving sequence packing by dynamic programming.

Each scan partition streams its documents in order as one run of tokens, every document closed
by an end token. Sequences are consecutive windows of that run. Candidate cuts are document
ends (free), sentence ends (a small penalty) and, inside sentences longer than ``LONG``, evenly
spaced hard cuts (a larger one). The cost of a sequence is its padding plus the penalty of its
cut, so with p the position of a candidate

    cost[i] = penalty[i] + length - p[i] + min(cost[j] + p[j])  over p[i] - length <= p[j] < p[i]

and the minimum over that moving range comes from a monotone queue: linear in candidates.
The program runs over blocks of ``BLOCK`` tokens; what follows the best last cut of a block is
carried into the next, so memory is bounded by a block and the longest document. The end of a
partition is cut into powers of two, which need no padding. Nothing is shuffled.

Tokens come from the tokenizer, but by one call for each distinct piece of a slice that is not
among a bounded number of known ones: the tokenizer drops white space and never joins across it, nor across the
bounds of letters, digits and marks.

Cases: null text is an empty document (one end token); empty tables give an empty result;
repeated rows are packed once each; other columns are ignored; texts longer than a sequence
span as many sequences as they need.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palimpsest.llm.words import LOWER_BYTE, U, buffers, equal_bytes, hashes, same_bytes, scan, slices

LENGTH = 2048
END_TOKEN = 1
BLOCK = 1 << 18
SENTENCE_PENALTY, HARD_PENALTY = 1, 24
#: Sentences of more tokens than this get hard cuts, so many tokens apart.
LONG, STEP = 96, 16
SLICE_BYTES = 512 << 10
#: Pieces that are kept, and the most bytes of one.
KNOWN, KNOWN_BYTES = 300_000, 64

#: Only these bytes separate chunks here; any other white space is left to the tokenizer.
_UNBROKEN = np.ones(256, bool)
_UNBROKEN[[0x09, 0x0A, 0x0D, 0x20]] = False
#: Kinds of bytes: chunks of letters, digits and marks alone are split as the tokenizer would.
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x27, 0x3C]] = _OTHER  # contractions, and the strings of special tokens
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE


def byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and plainness of the pieces of all rows, and the bytes to read them from.

    Plain pieces are lower-cased runs of ASCII or Latin-1 letters, runs of marks, or one digit.
    A chunk with anything else in it stays one piece.
    """
    kind, text = _KIND[raw], LOWER_BYTE[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    trail = raw[lead + 1]
    symbol = (trail == 0x97) | (trail == 0xB7)
    kind[lead + 1] = np.where(symbol, _OTHER, _LETTER)
    upper = (trail <= 0x9E) & ~symbol
    text[lead[upper] + 1] += 0x20
    starts, ends, _ = scan(raw, at, _UNBROKEN)
    odd = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kind == _OTHER, out=odd[1:])
    odd = odd[ends] > odd[starts]
    within = np.zeros(len(raw) + 1, np.int8)
    within[starts[odd]] = 1
    np.add.at(within, ends[odd], -1)
    within = np.cumsum(within[:-1], dtype=np.int8).astype(bool)
    kind[within] = _OTHER
    text[within] = raw[within]
    begin = kind != _SPACE
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin[starts] = True
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(raw))
    last = np.minimum(last, ends[np.searchsorted(ends, first, "right")])
    return first, last, kind[first] != _OTHER, text


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of an array one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Known:
    """Pieces with their ids, in flat arrays; when there are too many, those go that were not met since the last time."""

    def __init__(self) -> None:
        self.hash, self.order = np.zeros(0, U), np.zeros(0, np.int64)  # sorted, and the entry of each
        self.text, self.text_at, self.text_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.ids_at, self.ids_n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)

    def find(self, keys: np.ndarray, text: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The entry of each piece, byte by byte the same; -1 for those that aren't known."""
        if not len(self.hash):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.hash, keys), len(self.hash) - 1)
        entry = np.where(self.hash[place] == keys, self.order[place], -1)
        hit = np.flatnonzero(entry >= 0)
        same = equal_bytes(text, at[hit], n[hit], self.text, self.text_at[entry[hit]], self.text_n[entry[hit]])
        entry[hit[~same]] = -1
        self.met[entry[hit[same]]] = True
        return entry

    def add(self, keys: np.ndarray, text: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> None:
        """New pieces of small size, each with a hash of its own."""
        place = np.searchsorted(self.hash, keys)
        fresh = np.ones(len(keys), bool) if not len(self.hash) else self.hash[np.minimum(place, len(self.hash) - 1)] != keys
        ids_at = np.cumsum(ids_n) - ids_n
        keep = np.flatnonzero(fresh & (n <= KNOWN_BYTES))
        if len(self.met) + len(keep) > KNOWN:
            self._forget()
            place = np.searchsorted(self.hash, keys)
        entries = len(self.met) + np.arange(len(keep))
        self.hash, self.order = np.insert(self.hash, place[keep], keys[keep]), np.insert(self.order, place[keep], entries)
        self.text_at = np.concatenate([self.text_at, len(self.text) + np.cumsum(n[keep]) - n[keep]])
        self.ids_at = np.concatenate([self.ids_at, len(self.ids) + np.cumsum(ids_n[keep]) - ids_n[keep]])
        self.text, self.ids = np.concatenate([self.text, _gathered(text, at[keep], n[keep])]), np.concatenate([self.ids, _gathered(ids, ids_at[keep], ids_n[keep])])
        self.text_n, self.ids_n = np.concatenate([self.text_n, n[keep]]), np.concatenate([self.ids_n, ids_n[keep]])
        self.met = np.concatenate([self.met, np.ones(len(keep), bool)])

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met) if self.met.sum() <= KNOWN // 2 else np.zeros(0, np.int64)
        number = np.full(len(self.met), -1)
        number[kept] = np.arange(len(kept))
        stays = number[self.order] >= 0
        self.hash, self.order = self.hash[stays], number[self.order[stays]]
        self.text, self.ids = _gathered(self.text, self.text_at[kept], self.text_n[kept]), _gathered(self.ids, self.ids_at[kept], self.ids_n[kept])
        self.text_n, self.ids_n = self.text_n[kept], self.ids_n[kept]
        self.text_at, self.ids_at = np.cumsum(self.text_n) - self.text_n, np.cumsum(self.ids_n) - self.ids_n
        self.met = np.zeros(len(kept), bool)


class Words:
    """Token ids of whole texts; the tokenizer's model is asked once for each piece that isn't known."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = dict(enumerate(byte_characters()))
        self.known = Known()
        ends = [i for t, i in self.tokenizer.get_vocab().items() if (s := t.removesuffix("</w>")) and not s.strip(".!?") and t.endswith("</w>")]
        self.sentence_end = np.zeros(max(self.tokenizer.get_vocab_size(), END_TOKEN + 1) + 1, bool)
        self.sentence_end[ends] = True

    def encoded(self, piece: bytes, plain: bool) -> list[int]:
        """Ids of one piece: plain ones need none of the tokenizer's steps before its model."""
        if plain:
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.characters))]
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a run, and the offset of each row."""
        raw, at = buffers(texts)
        if not _UNBROKEN[raw].any():
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        starts, ends, plain, read = pieces(raw, at)
        keys = hashes(read, starts, ends)
        keys, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        # Pieces of equal hash that are not the same stand for themselves.
        unlike = np.flatnonzero(~same_bytes(read, starts, ends, index[inverse]))
        inverse[unlike] = len(index) + np.arange(len(unlike))
        index = np.concatenate([index, unlike])
        begin, size = starts[index], ends[index] - starts[index]
        entry = np.full(len(index), -1)
        entry[: len(keys)] = self.known.find(keys, read, begin[: len(keys)], size[: len(keys)])
        new = np.flatnonzero(entry < 0)
        found = [self.encoded(read[a : a + n].tobytes(), p) for a, n, p in zip(begin[new].tolist(), size[new].tolist(), plain[index[new]].tolist())]
        new_n = np.fromiter(map(len, found), np.int64, len(found))
        new_ids = np.fromiter(chain.from_iterable(found), np.uint32, int(new_n.sum()))
        known = entry >= 0
        counts, places = np.empty(len(index), np.int64), np.empty(len(index), np.int64)
        counts[known], places[known] = self.known.ids_n[entry[known]], self.known.ids_at[entry[known]]
        counts[new], places[new] = new_n, len(self.known.ids) + np.cumsum(new_n) - new_n
        flat = np.concatenate([self.known.ids, new_ids])
        own = int(np.searchsorted(new, len(keys)))
        self.known.add(keys[new[:own]], read, begin[new[:own]], size[new[:own]], new_ids, new_n[:own])
        each = counts[inverse]
        to = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=to[1:])
        return _gathered(flat, places[inverse], each), to[np.searchsorted(starts, at)]


def best_cuts(positions: list[int], penalties: list[int], length: int) -> tuple[list[float], list[int]]:
    """Least cost of ending a sequence at each position, and the position index where it starts."""
    cost, back = [0.0] * len(positions), [0] * len(positions)
    queue: deque[tuple[float, int, int]] = deque([(positions[0], positions[0], 0)])
    for i in range(1, len(positions)):
        p = positions[i]
        while queue and queue[0][1] < p - length:
            queue.popleft()
        if queue:
            value, _, back[i] = queue[0]
            cost[i] = value + length - p + penalties[i]
        else:
            cost[i] = float("inf")
        value = cost[i] + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, i))
    return cost, back


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions in (0, n] after position 0, with penalties."""
    at = np.union1d(np.union1d(doc_ends, sentence_ends), [0, n]).astype(np.int64)
    gaps = np.flatnonzero(np.diff(at) > LONG)
    hard = [np.arange(at[g] + STEP, at[g + 1], STEP) for g in gaps]
    all_at = np.union1d(at, np.concatenate(hard)) if hard else at
    penalty = np.full(len(all_at), HARD_PENALTY)
    penalty[np.isin(all_at, sentence_ends)] = SENTENCE_PENALTY
    penalty[np.isin(all_at, doc_ends)] = 0
    return all_at, penalty


def cut(doc_ends: np.ndarray, sentence_ends: np.ndarray, n: int, length: int, last: bool) -> list[int]:
    """Ends of sequences over n tokens; unless it is the last block, the end of it stays for the next."""
    if n == 0:
        return []
    at, penalty = candidates(doc_ends, sentence_ends, n)
    positions = at.tolist()
    cost, back = best_cuts(positions, penalty.tolist(), length)
    tail = np.flatnonzero(at > n - length)
    costs = np.array(cost)[tail]
    end = int(tail[len(costs) - 1 - int(np.argmin(costs[::-1]))])
    ends = []
    while end > 0:
        ends.append(positions[end])
        end = back[end]
    ends.reverse()
    if last:
        if ends and ends[-1] == n:
            ends.pop()
        done = ends[-1] if ends else 0
        rest = n - done
        while rest:  # powers of two need no padding
            size = min(length, 1 << (rest.bit_length() - 1))
            done, rest = done + size, rest - size
            ends.append(done)
    return ends


class Packer:
    """Sequences of one partition."""

    def __init__(self, tokenizer: str, length: int, partition: int) -> None:
        self.words, self.length = Words(tokenizer), length
        self.sequence = partition << 40
        self.ids = np.zeros(0, np.uint32)
        #: Of documents with tokens still to place: doc_id, place of the first token (maybe before 0), number of tokens.
        self.docs: list[tuple[int, int, int]] = []
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list[int], texts: pa.Array) -> Iterator[list[tuple]]:
        ids, at = self.words.ids(texts)
        for i, doc in enumerate(doc_ids):
            own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_TOKEN))
            self.docs.append((doc, self.size, len(own)))
            self.new.append(own)
            self.size += len(own)
            if self.size >= BLOCK:
                yield self.cut(False)

    def cut(self, last: bool) -> list[tuple]:
        ids = np.concatenate([self.ids, *self.new])
        place = np.array([p for _, p, _ in self.docs], np.int64)
        total = np.array([n for _, _, n in self.docs], np.int64)
        doc_ends = place + total
        sentences = np.flatnonzero(self.words.sentence_end[ids]) + 1
        ends = cut(doc_ends, sentences, len(ids), self.length, last)
        done = ends[-1] if ends else 0
        bounds = np.unique(np.concatenate([[0], ends, doc_ends[doc_ends <= done]])).astype(np.int64)
        a, b = bounds[:-1], bounds[1:]
        doc = np.searchsorted(doc_ends, a, "right")
        number = np.searchsorted(ends, a, "right")
        begins = np.concatenate([[0], ends])[number]
        rows = [
            (self.docs[d][0], x - int(place[d]), y - x, ids[x:y], int(total[d]), self.sequence + q, x - o)
            for d, x, y, q, o in zip(doc.tolist(), a.tolist(), b.tolist(), number.tolist(), begins.tolist())
        ]
        self.sequence += len(ends)
        self.ids, self.new, self.size = ids[done:], [], len(ids) - done
        self.docs = [(d, p - done, n) for d, p, n in self.docs if p + n > done]
        return rows


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, start, size, ids, tokens, sequence, offset = zip(*rows)
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
    out = {n: pa.array(v, pa.int64()) for n, v in zip(names, (doc, start, size, tokens, sequence, offset))}
    if with_ids:
        out["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
    else:
        out["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
    return pa.record_batch(out)


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """A row for each piece of a document: where it starts, its ids (or their CRC-32), its sequence and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokenizer, length, TaskContext.get().partitionId())
        for part in slices(batches, "text", SLICE_BYTES):
            for rows in packer.add(part.column(0).to_pylist(), part.column(1)):
                if rows:
                    yield _batch(rows, not digest)
        if packer.size and (rows := packer.cut(True)):
            yield _batch(rows, not digest)

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, " + ("ids_crc32 long" if digest else "ids array<int>")
    return documents.select("doc_id", "text").mapInArrow(run, schema)

"""Secret scanning: three base patterns, and guess costs of values in credential contexts.

A value after a credential word is segmented at least cost into dictionary words, dates,
repeats, character sequences, keyboard walks, separators and brute-force spans. The cost of a
segment is the logarithm of the guesses that it takes; a further segment adds the ways to order
them. A value is reported as kind ``guess``, unless it touches a base span, if it takes
``LEAST_GUESSES`` or more and some of its characters, ``LEAST_HARD`` at least, had to be guessed
one by one; or ``LEAST_PHRASE`` or more, whatever it is made of. Of an address with a scheme, or a path, the
parts between its delimiters are judged, each alone. Runs are measured once for a value, so the
program is linear in its length.

The dictionary is ``WORDS`` followed by the whole words of a public tokenizer's vocabulary, whose
ids go by frequency; the path of that file is a parameter.

Scanning works on buffers: long runs of hexadecimal digits, and places of the credential
words, are found for a whole slice at once, and only documents with one are read closer.

Cases: null and empty texts have no spans; values at the end of a text end there; repeated
rows are scanned alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.words import buffers, slices

KINDS = ("assign", "access", "hex", "guess")
LEAST_GUESSES, LEAST_PHRASE, LEAST_HARD = 10.0, 20.0, 4
SEGMENT_COST = 0.3
#: Shorter words of the vocabulary are mostly parts of words.
LEAST_WORD, LONGEST_WORD = 4, 20
#: Characters that a value has at least.
LEAST_VALUE = 6
SLICE_BYTES = 1 << 20

#: Base patterns and their least lengths (fixed values).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Credential words in some languages (fixed values).
CUES = "password passwd passphrase passcode pwd secret token apikey api_key api-key credential bearer passwort kennwort contraseña".split()
_CUE = re.compile(
    (r"""(?i)(?<![a-z])(?:""" + "|".join(CUES) + r""")s?["']?\s{0,3}(?::=|=>|[:=]|\s(?:is|ist|est|es)\s)\s{0,3}["']?([^\s"'<>]{6,})""")
)
#: Frequent words and passwords, the most frequent first (fixed values).
WORDS = (
    "password 123456 qwerty letmein welcome monkey dragon master login admin abc123 iloveyou sunshine princess football shadow "
    "secret test user guest root pass changeme default hello summer winter spring autumn love money home work house world "
    "the and for you your this that with from have not are was but all can one our out day get has him his how man new now "
    "old see two way who boy did its let put say she too use example sample dummy none null true false placeholder redacted "
    "token key api value string name email server client access private public database config production development local"
).split()
SEPARATORS = "-_./:,+="
_ADDRESS = re.compile(r"(?i)[a-z][a-z0-9+.-]*://|(?=[.~]{0,2}/)")
#: Rows of keyboards (fixed values).
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")
_NEXT = {(a, b) for row in KEYBOARD for r in (row, row[::-1]) for a, b in zip(r, r[1:])}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
_LEET = str.maketrans("013457@$!", "oleastasi")


@functools.cache
def ranks(vocabulary: str) -> dict[str, int]:
    """The place of each word in the dictionary; vocabulary is a tokenizer's JSON file that marks whole words with </w>."""
    with open(vocabulary, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    words = [*WORDS, *(w for w in whole if LEAST_WORD <= len(w) <= LONGEST_WORD and w.isascii() and w.isalpha())]
    return {w: i for i, w in enumerate(dict.fromkeys(words), 1)}


def _alphabet(value: str) -> int:
    kinds = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33))
    return max(10, sum(n for p, n in kinds if re.search(p, value)))


def _chain(n: int, joined: Callable[[int], bool], step: int = 1) -> list[int]:
    """For each place, how many joins in a row start there; joined(i) is about places i and i + step."""
    out = [0] * (n + step + 1)
    for i in range(n - step - 1, -1, -1):
        out[i] = out[i + 1] + 1 if joined(i) else 0
    return out


class Segments:
    """Pattern segments of a value; runs are measured once, so that each start costs the same however long they are."""

    def __init__(self, value: str, rank: dict[str, int]) -> None:
        self.rank, self.value, self.low = rank, value, value.lower()
        self.plain = self.low.translate(_LEET)
        n, low = len(value), self.low
        self.same = _chain(n, lambda i: value[i] == value[i + 1])
        self.steps = [_chain(n, lambda i, s=s: ord(value[i + 1]) - ord(value[i]) == s and value[i].isalnum() and value[i + 1].isalnum()) for s in (1, -1)]
        self.walk = _chain(n, lambda i: (low[i], low[i + 1]) in _NEXT)
        self.units = {u: _chain(n, lambda i, u=u: value[i] == value[i + u], u) for u in range(2, 9)}

    def starting(self, a: int) -> Iterator[tuple[int, float]]:
        """Ends of the segments that start at a, with log10 of their guesses."""
        value, n = self.value, len(self.value)
        if value[a] in SEPARATORS:
            yield a + 1, math.log10(len(SEPARATORS))
        for b in range(a + 3, min(n, a + LONGEST_WORD) + 1):
            for text, more in ((self.low[a:b], 0.0), (self.plain[a:b], 0.6)):
                if rank := self.rank.get(text):
                    yield b, math.log10(rank) + more + (0.0 if value[a:b] == self.low[a:b] else 0.5)
                    break
        if m := _DATE.match(value, a):
            yield m.end(), math.log10(365 * 60) if m.end() - a > 4 else 2.0
        if self.same[a] >= 2:
            yield a + self.same[a] + 1, 1.0 + math.log10(self.same[a] + 1)
        else:
            for u, joined in self.units.items():
                if times := joined[a] // u:
                    yield a + u * (times + 1), u * math.log10(_alphabet(value[a : a + u])) + math.log10(times + 1)
        for steps in self.steps:
            if steps[a] >= 2:
                yield a + steps[a] + 1, 1.5 + math.log10(steps[a] + 1)
        if self.walk[a] >= 2:
            yield a + self.walk[a] + 1, 2.0 + math.log10(self.walk[a] + 1)


def guess_cost(value: str, rank: dict[str, int]) -> tuple[float, int]:
    """log10 of the guesses that the cheapest segmentation takes, and how many characters it guesses one by one."""
    n = len(value)
    each = math.log10(_alphabet(value))
    segments = Segments(value, rank)
    best = [(0.0, 0)] + [(math.inf, 0)] * n
    brute = [(math.inf, 0)] * (n + 1)  # the same, with a brute-force span last
    for a in range(n):
        here, hard = best[a]
        brute[a + 1] = min((brute[a][0] + each, brute[a][1] + 1), (here + SEGMENT_COST + each, hard + 1))
        best[a + 1] = min(best[a + 1], brute[a + 1])
        for b, cost in segments.starting(a):
            best[b] = min(best[b], (here + SEGMENT_COST + cost, hard))
    return best[n]


def is_secret(value: str, rank: dict[str, int]) -> bool:
    """Whether a value in a credential context is too costly to guess."""
    if m := _ADDRESS.match(value):
        return any(len(part) >= LEAST_VALUE and is_secret(part, rank) for part in re.split(r"[/?&=#:@.]+", value[m.end() :]))
    cost, hard = guess_cost(value, rank)
    return cost >= LEAST_PHRASE or (cost >= LEAST_GUESSES and hard >= LEAST_HARD)


def _runs_of_hex(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    inside = ((raw >= 0x30) & (raw <= 0x39)) | ((raw >= 0x61) & (raw <= 0x66))
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= HEX_LEAST
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        cuts = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b, "left")].tolist()
        for x, y in zip([a, *cuts], [*cuts, b]):  # a run may pass from one text into the next
            if y - x >= HEX_LEAST:
                yield x, y


#: Beginnings in ASCII, since bytes are lower-cased as ASCII only; and the letters that _CUE takes for i, s or k.
_MARKS = [w.encode() for w in dict.fromkeys([*("pass" if c.startswith("pass") else re.match("[ -~]+", c)[0] for c in CUES), "apikey", "api_key", "secret", "token", *"\u0130\u0131\u017f\u212a"])]


def _documents_with(low: bytes, marks: list[bytes], at: np.ndarray) -> set[int]:
    out = set()
    for mark in marks:
        place = low.find(mark)
        while place >= 0:
            doc = int(np.searchsorted(at, place, "right")) - 1
            out.add(doc)
            place = low.find(mark, int(at[doc + 1]) - len(mark) + 1 if int(at[doc + 1]) - len(mark) + 1 > place else place + 1)
    return out


def spans_of(raw: np.ndarray, at: np.ndarray, rank: dict[str, int]) -> tuple[dict[int, list[tuple[int, int, int]]], np.ndarray]:
    """For each text with any: (start, kind, end) in code points, sorted."""
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    data = raw.tobytes()
    low = data.lower()
    found: dict[int, list[tuple[int, int, int]]] = {}

    def add(doc: int, kind: int, a: int, b: int) -> None:
        base = points[at[doc]]
        found.setdefault(doc, []).append((int(points[a] - base), kind, int(points[b] - base)))

    for a, b in _runs_of_hex(raw, at):
        add(int(np.searchsorted(at, a, "right")) - 1, 2, a, b)
    for doc in _documents_with(data, [b"AKIA"], at):
        start = int(at[doc])
        for m in ACCESS.finditer(data[start : int(at[doc + 1])]):
            if m.end() - m.start() >= ACCESS_LEAST:
                add(doc, 1, start + m.start(), start + m.end())
    for doc in _documents_with(low, _MARKS, at):
        start = int(at[doc])
        own = data[start : int(at[doc + 1])]
        for m in ASSIGN.finditer(own):
            if len(m[2]) >= ASSIGN_LEAST:
                add(doc, 0, start + m.start(), start + m.end())
        for m in _CUE.finditer(own.decode()):
            a, b = m.span(1)
            b -= len(m[1]) - len(m[1].rstrip(".,;:!?)]}"))
            touched = any(x < b and a < y for x, k, y in found.get(doc, ()) if k < 3)
            if b - a >= LEAST_VALUE and not touched and is_secret(m[1][: b - a], rank):
                found.setdefault(doc, []).append((a, 3, b))
    return {d: sorted(s) for d, s in found.items()}, points


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans and all spans as text."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            n = part.num_rows
            counts, digests, spans = np.zeros((3, n), np.int64), [empty] * n, [""] * n
            for doc, own in spans_of(*buffers(part.column(1)), ranks(vocabulary))[0].items():
                base = [s for s in own if s[1] < 3]
                for _, kind, _ in base:
                    counts[kind, doc] += 1
                digests[doc] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[doc] = _joined(own)
            yield pa.record_batch(
                {
                    "doc_id": part.column(0),
                    **{f"n_{k}": pa.array(c) for k, c in zip(KINDS, counts)},
                    "base_sha256": pa.array(digests, pa.string()),
                    "spans": pa.array(spans, pa.string()),
                }
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

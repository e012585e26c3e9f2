"""Vectorised word scanning over the UTF-8 buffers of Arrow columns.

Every function works on whole buffers with NumPy, so a batch costs some nanoseconds a byte and
no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
K_BYTE = 0x9E3779B97F4A7C15
K_WORD = 0xD1342543DE82EF95


def splitmix(n: int, seed: int) -> np.ndarray:
    """n 64-bit values from the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche: every bit of x reaches every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


#: Words of more bytes than this are hashed one by one, by XXH64.
LONG_WORD = 256
#: The first n of eight bytes, n from 0 to 8.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

#: Words are runs of bytes outside [\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of [0-9a-z] after lower-casing A-Z, and of anything beyond ASCII.
WORD_LIKE = np.ones(256, bool)
WORD_LIKE[:0x80] = False
WORD_LIKE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 0x20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = buffers(batch.column(batch.schema.get_field_index(text)))[1][1:]
        row = 0
        while row < batch.num_rows:
            done = ends[row - 1] if row else 0
            to = max(row + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(row, to - row)
            row = to


def scan(raw: np.ndarray, at: np.ndarray, wordlike: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each row (one more at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = wordlike[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, zeros after the last, without a copy for each."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words wherever they stand.

    Eight bytes at a time go through an avalanche step, which no sum or difference of
    neighbouring bytes cancels; only as many rounds run as the longest short word has.
    """
    if lower:
        raw = LOWER_BYTE[raw]
    sizes = ends - starts
    eights = _eights(raw)
    with np.errstate(over="ignore"):
        out = sizes.astype(U) * U(K_BYTE)
        live = np.flatnonzero(sizes <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            live = live[sizes[live] > at]
            if not len(live):
                break
            block = eights[starts[live] + at] & _FIRST_BYTES[np.minimum(sizes[live] - at, 8)]
            out[live] = mix(out[live] * U(K_WORD) + block)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), K_BYTE)
    return out


def equal_bytes(raw: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, other_at: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """Whether words of one buffer, by places and sizes, equal words of another, byte by byte."""
    same = n == other_n
    left, right = _eights(raw), _eights(other)
    live = np.flatnonzero(same & (n <= LONG_WORD))
    for k in range(0, LONG_WORD, 8):
        live = live[n[live] > k]
        if not len(live):
            break
        unlike = (left[at[live] + k] ^ right[other_at[live] + k]) & _FIRST_BYTES[np.minimum(n[live] - k, 8)]
        same[live[unlike != 0]] = False
    for i in np.flatnonzero(same & (n > LONG_WORD)).tolist():
        same[i] = bool((raw[at[i] : at[i] + n[i]] == other[other_at[i] : other_at[i] + n[i]]).all())
    return same


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each word equals, byte by byte, the word whose number is given for it."""
    same = np.ones(len(starts), bool)
    apart = np.flatnonzero(others != np.arange(len(others)))
    sizes, to = ends - starts, others[apart]
    same[apart] = equal_bytes(raw, starts[apart], sizes[apart], raw, starts[to], sizes[to])
    return same


class Spans:
    """Fingerprints of runs of at most ``longest`` symbols.

    Runs of 1, 2, 4, ... symbols are named by an avalanche step over the names of their halves;
    a run of any length is told by the two runs of a power of two that begin and end it.
    """

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        levels, width = [symbols], 1
        with np.errstate(over="ignore"):
            while 2 * width <= longest:
                halves = levels[-1]
                whole = halves.copy()
                if len(halves) > width:
                    whole[:-width] = mix(halves[:-width] * U(K_WORD) + halves[width:])
                levels.append(whole)
                width *= 2
        self.names = np.stack(levels)
        self.level = np.array([0, *(n.bit_length() - 1 for n in range(1, longest + 1))])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        level = self.level[size]
        with np.errstate(over="ignore"):
            return mix(mix(self.names[level, start] + size.astype(U) * U(K_BYTE)) * U(K_WORD) + self.names[level, end - (1 << level)])

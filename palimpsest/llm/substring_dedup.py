"""Substring deduplication by recompression.

Each document is rewritten in rounds. A round names every maximal run of one symbol, then every
pair of a left-class and a right-class symbol. A name is a keyed hash of what it stands for, so
the naming is global without a dictionary: equal runs and pairs get equal names in every
document, executor and attempt. With every symbol goes its context, the stretch of words that
decided all the choices that made it. Equal stretches of text therefore hold equal symbols
wherever the context lies inside the stretch.

A window of ``window`` words is keyed by its leftmost symbol of the highest round whose context
it contains, together with a fingerprint of that context. Two Spark rounds follow:

* Reveal: keys are counted over the corpus; a window whose key occurs once has no copy.
* Verify: windows under shared keys are compared by 64-bit fingerprints of all their words,
  within the bucket of their key.

Documents first become a table of chunks (a few MB of documents each) in the shared folder,
bucketed by chunk, so both rounds and the final pass read text in place. A chunk sends each
key or window to its bucket once, however often it holds it, and gets one bit back. So a
passage in a third of all documents costs one entry a chunk, and no pairs are made. Chunks beyond
``GROUP`` are summed up by group before they meet, so that no bucket holds an entry of every chunk.

Cases: null text has no words; a text of fewer words than the window keeps all; an empty table
gives an empty result; repeated rows are copies of each other; columns other than ``doc_id``
and ``text`` are ignored; runs of one word and periodic text fall back to lower rounds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import checkpointed, saved, shuffle_partitions, written
from palimpsest.llm.words import NOT_SPACE, Spans, U, buffers, hashes, mix, scan, slices

ROUNDS = 6
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
#: Chunks whose entries meet in one task.
GROUP = 4096
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def rewrite(symbols: np.ndarray, barrier: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each round with the bounds of their contexts, which never decrease.

    The first and last symbols are barriers, as are those between documents.
    """
    n = len(symbols)
    sym, lo, hi, bar = symbols, np.arange(n), np.arange(1, n + 1), barrier
    levels = [(sym, lo, hi)]
    with np.errstate(over="ignore"):
        for number in range(1, rounds + 1):
            # Runs: what follows or precedes decides that a run ends.
            head = np.ones(len(sym), bool)
            head[1:] = sym[1:] != sym[:-1]
            first = np.flatnonzero(head)
            length = np.diff(first, append=len(sym))
            before, after = np.maximum(first - 1, 0), np.minimum(first + length, len(sym) - 1)
            sym, bar = sym[first], bar[first]
            lo, hi = lo[before], hi[after]
            long = length > 1
            if long.any():
                sym = np.where(long, mix(sym * U(0xA0761D6478BD642F) + length.astype(U)), sym)
            # Pairs: a left symbol followed by a right one.
            left = (mix(sym ^ U(number * 0x51ED270B)) >> U(63)).astype(bool)
            joins = np.zeros(len(sym), bool)
            joins[:-1] = left[:-1] & ~left[1:] & ~bar[:-1] & ~bar[1:]
            second = np.zeros(len(sym), bool)
            second[1:] = joins[:-1]
            nxt = np.minimum(np.arange(1, len(sym) + 1), len(sym) - 1)
            named = np.where(joins, mix(sym * U(0xE7037ED1A0B428DB) + mix(sym[nxt] + U(number))), sym)
            new_hi = np.where(left, hi[nxt], hi)
            new_lo = np.where(left, lo, lo[np.maximum(np.arange(len(sym)) - 1, 0)])
            keep = ~second
            sym, lo, hi, bar = named[keep], new_lo[keep], new_hi[keep], bar[keep]
            levels.append((sym, lo, hi))
    return levels


class Chunk:
    """Windows of the documents of one chunk and their keys."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.window = window
        raw, at = buffers(texts)
        starts, ends, self.first = scan(raw, at, NOT_SPACE)
        rows = len(at) - 1
        self.n_words = np.diff(self.first)
        size = len(starts) + rows + 1
        barrier = np.zeros(size, bool)
        #: The place of the first word of each document among words and barriers.
        self.place = self.first[:-1] + np.arange(rows) + 1
        barrier[np.append(self.place - 1, size - 1)] = True
        symbols = np.empty(size, U)
        symbols[~barrier] = hashes(raw, starts, ends)
        symbols[barrier] = mix(np.arange(rows + 1, dtype=U) + U(0xB5))
        spans = Spans(symbols, window)
        valid = np.zeros(size + 1, np.int64)
        fits = self.n_words >= window
        np.add.at(valid, self.place[fits], 1)
        np.add.at(valid, (self.place + self.n_words - window + 1)[fits], -1)
        self.starts = np.flatnonzero(np.cumsum(valid)[:-1])
        self.spans, self.size = spans, size
        keys = np.zeros(len(self.starts), U)
        occurring = [np.zeros(0, U)]
        left = np.arange(len(self.starts))
        levels = rewrite(symbols, barrier)
        for number in range(len(levels) - 1, -1, -1):
            if not len(left):
                break
            sym, lo, hi = levels[number]
            at_or_after = np.zeros(size + 1, np.int64)
            np.cumsum(np.bincount(lo, minlength=size), out=at_or_after[1:])
            start = self.starts[left]
            k = at_or_after[start]
            inside = k < len(sym)
            k = np.minimum(k, len(sym) - 1)
            inside &= hi[k] <= start + window
            k, found = k[inside], left[inside]
            if len(k):
                new = np.ones(len(k), bool)
                new[1:] = k[1:] != k[:-1]
                own = k[new]
                with np.errstate(over="ignore"):
                    named = mix(sym[own] + spans(lo[own], hi[own]) + U(number))
                keys[found] = named[np.cumsum(new) - 1]
                occurring.append(named)
            left = left[~inside]
        self.keys = keys
        #: One entry for each place of a symbol that keys windows, however many it keys.
        self.occurring = np.concatenate(occurring)

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.occurring, return_counts=True)

    def prints(self, which: np.ndarray) -> np.ndarray:
        start = self.starts[which]
        return self.spans(start, start + self.window)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A bucket from the high half of each key; never decreases with the key."""
    return (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def _sent(chunk_id: int, buckets: np.ndarray, values: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; values and buckets are sorted by bucket."""
    cut = np.flatnonzero(np.diff(buckets, prepend=-1)) if len(buckets) else np.zeros(0, np.int64)
    to = np.append(cut[1:], len(buckets))
    return pa.record_batch(
        {
            "bucket": pa.array(buckets[cut], pa.int64()),
            "chunk_id": pa.array([chunk_id] * len(cut), pa.int64()),
            "entries": pa.array([values[a:b].tobytes() for a, b in zip(cut, to)], pa.binary()),
            "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(cut, to)], pa.binary()),
        }
    )


_SENT = "bucket long, chunk_id long, entries binary, many binary"


def _values(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of some rows, whether each occurs more than once, here or where it was sent from, and where rows end."""
    entries = [np.frombuffer(x, U) for x in rows["entries"].to_pylist()]
    sizes = [len(x) for x in entries]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["many"].to_pylist(), sizes)]).astype(bool)
    values = np.concatenate(entries)
    order = np.argsort(values)
    ordered = values[order]
    again = np.zeros(len(values), bool)
    same = ordered[1:] == ordered[:-1]
    again[1:] |= same
    again[:-1] |= same
    shared = many.copy()
    shared[order] |= again
    return values, shared, np.cumsum(sizes)[:-1]


def _distinct(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether any place of each is shared."""
    unique, inverse = np.unique(values, return_inverse=True)
    any_ = np.zeros(len(unique), bool)
    any_[inverse[shared]] = True
    return unique, any_


def _answer(rows: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk_id": rows["chunk_id"], "bucket": rows["bucket"], "shared": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})


def _shared(rows: pa.Table) -> pa.Table:
    """For the rows of one bucket, a bit for each entry: does it occur more than once in the corpus?"""
    _, shared, cuts = _values(rows)
    return _answer(rows, np.split(shared, cuts))


def _summed(rows: pa.Table) -> pa.Table:
    """The rows of one bucket and group of chunks as one row, as if the group were a chunk."""
    unique, many = _distinct(*_values(rows)[:2])
    return pa.table({"bucket": rows["bucket"][:1], "chunk_id": rows["part"][:1], "entries": pa.array([unique.tobytes()], pa.binary()), "many": pa.array([np.packbits(many).tobytes()], pa.binary())})


def _dealt(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """For the rows of one bucket and group of chunks, the group's answer for each entry."""
    values, shared, cuts = _values(rows)
    unique, _ = _distinct(values, shared)
    bits = np.unpackbits(np.frombuffer(answers["shared"][0].as_py(), np.uint8), count=len(unique)).astype(bool)
    return _answer(rows, np.split(bits[np.searchsorted(unique, values)], cuts))


_SHARED = "chunk_id long, bucket long, shared binary"


def _answered(sent: DataFrame, name: str, chunks: int) -> DataFrame:
    """Bits for each chunk, as a list over buckets.

    An entry that every chunk holds would bring one for each of them into its bucket. So chunks of
    a large corpus are dealt into groups of some ``GROUP``; a group sums up its entries by bucket,
    the groups' sums meet, and each group deals the answers to its chunks. No task then holds more
    than ``GROUP`` places of an entry, or one for each group.
    """
    groups = -(-chunks // GROUP)
    if groups <= 1:
        bits = sent.groupBy("bucket").applyInArrow(_shared, _SHARED)
    else:
        sent = written(sent.withColumn("part", F.pmod("chunk_id", F.lit(groups))), f"sent-{name}")
        sums = sent.groupBy("bucket", "part").applyInArrow(_summed, _SENT)
        answers = sums.groupBy("bucket").applyInArrow(_shared, _SHARED).withColumnRenamed("chunk_id", "part")
        bits = sent.groupBy("bucket", "part").cogroup(answers.groupBy("bucket", "part")).applyInArrow(_dealt, _SHARED)
    return bits.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "shared")).alias(name))


def _bits(answers: list[dict] | None, buckets: np.ndarray) -> np.ndarray:
    """Answers in the order of the entries that were sent."""
    out = np.zeros(len(buckets), bool)
    for answer in answers or []:
        a, b = np.searchsorted(buckets, [answer["bucket"], answer["bucket"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(answer["shared"], np.uint8), count=b - a)
    return out


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i] for c in columns)


def _windows_to_verify(chunk: Chunk, buckets: int, answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows under shared keys: which, their buckets and fingerprints."""
    unique, _ = chunk.distinct_keys()
    shared = unique[_bits(answers, bucket_of(unique, buckets))]
    place = np.minimum(np.searchsorted(shared, chunk.keys), max(len(shared) - 1, 0))
    which = np.flatnonzero(shared[place] == chunk.keys) if len(shared) else np.zeros(0, np.int64)
    return which, bucket_of(chunk.keys[which], buckets), chunk.prints(which)


def _distinct_prints(bucket: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (bucket, print), the number of windows of each, and each window's place among them."""
    order = np.lexsort((prints, bucket))
    b, p = bucket[order], prints[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1])
    number = np.cumsum(new) - 1
    inverse = np.empty(len(order), np.int64)
    inverse[order] = number
    return b[new], p[new], np.bincount(number, minlength=int(new.sum())), inverse


def chunks(documents: DataFrame, name: str) -> DataFrame:
    """Documents in lists of a few MB, in a table of the shared folder that is bucketed by chunk."""
    spark = documents.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            texts = part.column(1).fill_null("")
            offsets = pa.array([0, part.num_rows], pa.int32())
            yield pa.record_batch(
                {
                    "chunk_id": pa.array([uuid.uuid4().int >> 65], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(offsets, part.column(0)),
                    "texts": pa.ListArray.from_arrays(offsets, texts),
                    "n_bytes": pa.array([int(buffers(texts)[1][-1])], pa.int64()),
                }
            )

    made = documents.select("doc_id", "text").mapInArrow(gather, "chunk_id long, doc_ids array<long>, texts array<string>, n_bytes long")
    writer = made.write.bucketBy(shuffle_partitions(spark), "chunk_id").option("parquet.block.size", str(4 * CHUNK_BYTES))
    return spark.table(saved(writer, spark, name))


def repeated_windows(documents: DataFrame, window: int, finish: Callable[[pa.Array, pa.Array, "Chunk", np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Finds all windows that occur more than once and hands each chunk with its words to remove to ``finish``."""
    spark: SparkSession = documents.sparkSession
    table = chunks(documents, "chunks")
    total, number = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    n = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk_id, texts in _rows(batches, "chunk_id", "texts"):
            unique, counts = Chunk(texts.values, window).distinct_keys()
            yield _sent(chunk_id.as_py(), bucket_of(unique, n), unique, counts > 1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk_id, texts, keys in _rows(batches, "chunk_id", "texts", "keys"):
            _, bucket, prints = _windows_to_verify(Chunk(texts.values, window), n, keys.as_py())
            b, p, counts, _ = _distinct_prints(bucket, prints)
            yield _sent(chunk_id.as_py(), b, p, counts > 1)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, keys, windows in _rows(batches, "doc_ids", "texts", "keys", "windows"):
            chunk = Chunk(texts.values, window)
            which, bucket, prints = _windows_to_verify(chunk, n, keys.as_py())
            b, _, _, inverse = _distinct_prints(bucket, prints)
            repeated = chunk.starts[which[_bits(windows.as_py(), b)[inverse]]]
            edge = np.zeros(chunk.size + window + 1, np.int64)
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + window, -1)
            yield finish(doc_ids.values, texts.values, chunk, np.cumsum(edge)[: chunk.size] > 0)

    keys = checkpointed(_answered(table.select("chunk_id", "texts").mapInArrow(reveal, _SENT), "keys", number))
    keyed = table.join(keys, "chunk_id", "left")
    windows = checkpointed(_answered(keyed.select("chunk_id", "texts", "keys").mapInArrow(verify, _SENT), "windows", number))
    return keyed.join(windows, "chunk_id", "left").select("doc_ids", "texts", "keys", "windows").mapInArrow(remove, schema)


def _kept(texts: pa.Array, chunk: Chunk, removed: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for raw, place, n in zip(texts.cast(pa.binary()).to_pylist(), chunk.place.tolist(), chunk.n_words.tolist()):
        gone = removed[place : place + n]
        words = raw.split()
        lost = int(gone.sum())
        yield lost, b" ".join(compress(words, (~gone).tolist()) if lost else words)


def substring_dedup(documents: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, kept text, and the counts: every word in a window that occurs more than once is removed."""

    def finish(doc_ids: pa.Array, texts: pa.Array, chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        kept = list(_kept(texts, chunk, removed))
        return pa.record_batch(
            {"doc_id": doc_ids, "n_words": pa.array(chunk.n_words, pa.int64()), "n_removed": pa.array([x for x, _ in kept], pa.int64()), "text": pa.array([x.decode() for _, x in kept], pa.string())}
        )

    return repeated_windows(documents, window, finish, "doc_id long, n_words long, n_removed long, text string")


def digest(documents: DataFrame, window: int = 35) -> DataFrame:
    """As :func:`substring_dedup`, with the SHA-256 of the kept text in its place."""

    def finish(doc_ids: pa.Array, texts: pa.Array, chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        kept = [(n, hashlib.sha256(x).hexdigest()) for n, x in _kept(texts, chunk, removed)]
        return pa.record_batch(
            {"doc_id": doc_ids, "n_words": pa.array(chunk.n_words, pa.int64()), "n_removed": pa.array([x for x, _ in kept], pa.int64()), "kept_sha256": pa.array([x for _, x in kept], pa.string())}
        )

    return repeated_windows(documents, window, finish, _RESULT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (
  SELECT *, string_agg(word, ' ') OVER f AS h, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), again AS (SELECT h FROM g WHERE n = 35 GROUP BY h HAVING count(*) > 1),
m AS (SELECT g.doc_id, g.i, g.word, again.h IS NOT NULL AND g.n = 35 AS starts FROM g LEFT JOIN again ON g.h = again.h),
c AS (SELECT *, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m)
SELECT d.doc_id, count(c.i) AS n_words, count(*) FILTER (WHERE c.gone) AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""

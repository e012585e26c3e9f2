"""Benchmark decontamination with an FM-index for each training shard.

A phrase is a window of ``width`` consecutive words of a benchmark item, or all words of a
shorter item. A shard is some MB of documents. Its words become numbers of the benchmark's
vocabulary; stretches in which every pair of neighbours also stands side by side in a phrase
are kept, with a separator of its own after each, since no phrase can occur elsewhere. Over
these an FM-index is built: suffix array by prefix doubling, Burrows-Wheeler transform, a
wavelet matrix for ranks, and suffix positions sampled at every eighth place and at the start
of each stretch. All phrases of one length are searched backward together; occurrences are
located by walking to a sampled position; their spans are merged.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words (or one longer item). One block
is broadcast at a time, so neither the driver nor a worker ever holds more. A benchmark of one
block takes one pass, and nothing is shuffled. A larger one takes a pass a block, whose hits are
written to the shared folder; they are merged by document, and only documents with hits travel.

Cases: null or empty documents and items have no words; items that equal each other all count;
repeated rows are judged each on its own; an empty benchmark leaves every document clean;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written
from palimpsest.llm.words import WORD_LIKE, buffers, hashes, scan, slices

WIDTH = 13
SHARD_BYTES = 1 << 20
BLOCK_WORDS = 500_000
SAMPLE = 8


class Phrases:
    """One block of the benchmark: vocabulary, neighbouring pairs, and distinct phrases by length."""

    def __init__(self, items: list[tuple[object, str | None]], width: int) -> None:
        raw, at = buffers(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = scan(raw, at, WORD_LIKE)
        words = hashes(raw, starts, ends, lower=True)
        self.vocabulary, code = np.unique(words, return_inverse=True)
        code = code + 1
        found: dict[tuple[int, ...], set[str]] = {}
        pairs = set()
        for (item, _), (a, b) in zip(items, pairwise(first.tolist())):
            own = tuple(code[a:b].tolist())
            pairs.update(pairwise(own))
            for i in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(own[i : i + width], set()).add(str(item))
        self.sigma = len(self.vocabulary) + 1
        self.pairs = np.array(sorted(a * self.sigma + b for a, b in pairs), np.int64)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for phrase in found:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.by_length = {n: (np.array(p, np.int64), [sorted(found[x]) for x in p]) for n, p in by_length.items()}
        self.shortest = min(by_length, default=0)


def blocks(benchmark: DataFrame, width: int) -> Iterator[Phrases]:
    block, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        n = len((text or "").split()) + 1
        if block and size + n > BLOCK_WORDS:
            yield Phrases(block, width)
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield Phrases(block, width)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling: ranks by the first k symbols give ranks by 2k."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(text)
    while True:
        later = np.zeros(n, np.int64)
        later[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) > 0)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """text: symbols from 1; 0 separates stretches and also ends the text."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        n = len(text)
        gap = text == 0
        # Separators all differ, in order of position, so that no common prefix passes one.
        distinct = np.where(gap, np.cumsum(gap) - 1, text + n)
        order = suffix_array(distinct)
        before = text[order - 1]  # the text ends with a separator, which stands before its start
        starts = np.bincount(text, minlength=sigma + 1)
        self.first = np.cumsum(starts) - starts
        self.bits = max(1, int(sigma).bit_length())
        self.ranks, self.zeros = [], []
        row = before
        for bit in range(self.bits - 1, -1, -1):
            one = (row >> bit) & 1 == 1
            ones = np.zeros(n + 1, np.int64)
            np.cumsum(one, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(n - int(ones[-1]))
            row = np.concatenate([row[~one], row[one]])
        self.before = before
        known = (order % SAMPLE == 0) | (before == 0)
        self.known = known
        self.known_rank = np.cumsum(known) - 1
        self.sampled = order[known]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low, high = np.zeros_like(place), place
        for ones, zeros, bit in zip(self.ranks, self.zeros, range(self.bits - 1, -1, -1)):
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each row of phrases."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.before), np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        high[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes, by steps back to a sampled one."""
        steps, left, at = np.zeros(len(places), np.int64), np.arange(len(places)), places.copy()
        while len(left := left[~self.known[at[left]]]):
            symbol = self.before[at[left]]
            at[left] = self.first[symbol] + self.rank(symbol, at[left])
            steps[left] += 1
        return self.sampled[self.known_rank[at]] + steps


def occurrences(words: np.ndarray, first: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each length of phrase: start words and phrase numbers of all occurrences in a shard."""
    if not phrases.shortest or not len(words):
        return
    code = np.searchsorted(phrases.vocabulary, words)
    code = np.where(phrases.vocabulary[np.minimum(code, len(phrases.vocabulary) - 1)] == words, code + 1, 0)
    linked = np.zeros(len(words), bool)  # to the next word
    both = np.flatnonzero((code[:-1] > 0) & (code[1:] > 0))
    if len(phrases.pairs):
        pair = code[both] * phrases.sigma + code[both + 1]
        at = np.minimum(np.searchsorted(phrases.pairs, pair), len(phrases.pairs) - 1)
        linked[both[phrases.pairs[at] == pair]] = True
    linked[first[1:][first[1:] > 0] - 1] = False  # documents without words may come first
    begins = np.flatnonzero((code > 0) & ~np.concatenate([[False], linked[:-1]]))
    ends = np.flatnonzero((code > 0) & ~linked) + 1
    long = ends - begins >= phrases.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return
    sizes = ends - begins + 1
    to = np.cumsum(sizes)
    place = np.repeat(begins - (to - sizes), sizes) + np.arange(to[-1])
    text = code[np.minimum(place, len(code) - 1)]
    text[to - 1] = 0
    index = FMIndex(text, phrases.sigma)
    for width, (rows, _) in phrases.by_length.items():
        low, high = index.search(rows)
        n = high - low
        which = np.repeat(np.arange(len(rows)), n)
        places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield place[index.locate(places)], which, width


def _shard(texts: pa.Array, phrases: Phrases | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """First word of each text, whether each word is hit, how many hits each text has, and its items."""
    raw, at = buffers(texts)
    starts, ends, first = scan(raw, at, WORD_LIKE)
    edge = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    if phrases is not None:
        for begin, which, width in occurrences(hashes(raw, starts, ends, lower=True), first, phrases):
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + width, -1)
            doc = np.searchsorted(first, begin, "right") - 1
            names = phrases.by_length[width][1]
            for pair in np.unique(doc * len(names) + which).tolist():
                items.setdefault(pair // len(names), set()).update(names[pair % len(names)])
    hit = np.cumsum(edge)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    return first, hit, total[first[1:]] - total[first[:-1]], [sorted(items.get(d, ())) for d in range(len(at) - 1)]


def _is_contaminated(n_hit, n_words):
    """The rule, of arrays as of columns."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "doc_id long, version long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def _pass(documents: DataFrame, phrases: Phrases | None, only_hits: bool) -> tuple[DataFrame, Broadcast]:
    """A row a document, or only those with hits, for one block."""
    sent = documents.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SHARD_BYTES):
            first, hit, n_hit, items = _shard(part.column(1), sent.value)
            spans = [_spans(hit[a:b]) if n else [] for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), n_hit.tolist())]
            made = pa.record_batch(
                {
                    "doc_id": part.column(0), "version": part.column(2), "n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                    "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, _SPANS),
                }
            )
            yield made.filter(pa.array(n_hit > 0)) if only_hits else made

    return documents.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, _FOUND), sent


def _merged(documents: DataFrame, blocks_: Iterator[Phrases]) -> DataFrame:
    """Hits of several blocks, one row for each document with any; repeated rows of one text are one."""
    hits = None
    for phrases in blocks_:
        found, sent = _pass(documents, phrases, True)
        own = written(found, "hits")
        sent.destroy()
        hits = own if hits is None else hits.unionByName(own)
    gathered = hits.groupBy("doc_id", "version").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all")
    )
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def joined(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (span["start"] <= last["end"]), grown).otherwise(F.concat(done, F.array(span)))

    merged = gathered.withColumn("spans", F.aggregate("all", none, joined))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return written(merged.select("doc_id", "version", "n_words", n_hit.alias("n_hit"), "items", "spans"), "contamination")


def _blocks_of(benchmark: DataFrame, width: int) -> tuple[Phrases | None, Iterator[Phrases] | None]:
    """The only block of a benchmark, or all of several."""
    found = blocks(benchmark, width)
    first, second = next(found, None), next(found, None)
    return (first, None) if second is None else (None, chain([first, second], found))


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Words hit, the items they come from, the merged spans of words to remove, and the verdict on each document."""
    one, many = _blocks_of(benchmark, width)
    found, _ = _pass(documents, one, False)
    if many is not None:
        own = _merged(documents, many).select("doc_id", "version", "n_hit", "items", "spans")
        counted = found.select(F.col("doc_id").alias("of"), F.col("version").alias("at"), "n_words")
        joined = counted.join(own, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("version")), "left")
        none = lambda c: F.coalesce(c, F.array().cast(own.schema[c].dataType))
        found = joined.select(F.col("of").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), none("items").alias("items"), none("spans").alias("spans"))
    return found.select("doc_id", "n_words", "n_hit", "items", "spans", _is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def digest(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """As :func:`decontaminate`, with a count and a digest of the items."""
    found = decontaminate(documents, benchmark, width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, whole and with all their columns, that are not contaminated."""
    one, many = _blocks_of(benchmark, width)
    if many is not None:
        whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
        bad = _merged(documents, many).filter(_is_contaminated(F.col("n_hit"), F.col("n_words")))
        kept = whole.join(bad, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("version")), "left_anti")
        return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
    sent = documents.sparkSession.sparkContext.broadcast(one)
    at = documents.columns.index("text")
    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])  # names with dots can't be passed on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}", SHARD_BYTES):
            first, _, n_hit, _ = _shard(part.column(at), sent.value)
            yield part.filter(pa.array(~_is_contaminated(n_hit, np.diff(first))))

    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)


def oracle_sql(width: int = WIDTH) -> str:
    """The digest in SQL: windows of every length from one word to the width, joined with the phrases of that length."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    found = " UNION ALL ".join(
        f"""SELECT p.item_id, d.doc_id, d.i, {k} AS n FROM (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS h, count(*) OVER f AS n FROM dw WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)
) d JOIN p ON p.n = {k} AND d.n = {k} AND d.h = p.h"""
        for k in range(1, width + 1)
    )
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
p AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), {width}) - 1], ' ') AS h, least(len(w), {width}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), f AS ({found}),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM f),
n AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

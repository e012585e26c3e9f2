"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: a bit is set where more than half of the hashes of a document's three-word
shingles have it. Two fingerprints link at ``distance`` or fewer differing bits.

Search over the distinct fingerprints:

* Statistics over all of them: how often each bit, and each pair of bits, is set.
* Bits are grouped into ``parts`` partitions, correlated bits together.
* Partition i gets a threshold t_i >= -1 with sum t_i = distance - parts + 1. Fingerprints
  within ``distance`` then lie within t_i in at least one partition. Dynamic programming picks
  the thresholds with the least candidate pairs, estimated from how often the values of each
  partition meet over all fingerprints.
* Probe: each fingerprint goes to the bucket of its value in every partition with t_i >= 0,
  and to those of all values within t_i.
* Verify: a bucket compares its fingerprints and reports only a star of each group it links.

A bucket of more than ``BUCKET`` fingerprints is split again by the plain pigeonhole over the
bits on which its fingerprints may differ, until it fits: with 12 such bits no bucket of distinct
fingerprints is larger. Fingerprints in the bucket of a near value may differ in all bits; what
that bucket was stays part of the key (``of``). So no bucket has a cap and none is compared whole
in one task. Components come from
alternating large and small stars over the reported links, in rounds that end in checkpoint().

Fingerprints and their documents meet by ``split_join``, so that the copies of one text, a third of
all documents or more, don't meet in one task.

Cases: null and empty texts have fingerprint zero, which links like any other; texts of one or
two words are one shingle; repeated rows keep their own row; a component_id is the least doc_id
that there is, null only where no row of the component has one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.shared import checkpointed, split_join, written
from palimpsest.llm.words import LOWER_BYTE, NOT_SPACE, U, buffers, scan, slices

SHINGLE, SEED, BITS = 3, 42, 64
DISTANCE, PARTS = 3, 4
BUCKET = 4096
SLICE_BYTES = 1 << 20


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    raw, at = buffers(texts)
    raw = LOWER_BYTE[raw]
    starts, ends, first = scan(raw, at, NOT_SPACE)
    rows = len(at) - 1
    out = np.zeros(rows, U)
    if not len(starts):
        return out
    # Words and one space after each, so that a shingle is one slice.
    keep = NOT_SPACE[raw]
    after = ends[ends < len(raw)]
    keep[after] = True
    shift = np.cumsum(keep) - keep
    buffer = raw.copy()
    buffer[after[~NOT_SPACE[raw[after]]]] = 0x20
    joined = buffer[keep].tobytes()
    n = np.diff(first)
    short = np.minimum(n, SHINGLE)
    shingles = np.where(n > 0, n - short + 1, 0)
    total = int(shingles.sum())
    row_start = np.cumsum(shingles) - shingles
    begin = np.repeat(first[:-1] - row_start, shingles) + np.arange(total)
    last = begin + np.repeat(short, shingles) - 1
    digest = xxhash.xxh64_intdigest
    a, b = shift[starts[begin]].tolist(), (shift[ends[last] - 1] + 1).tolist()
    values = np.array([digest(joined[x:y], SEED) for x, y in zip(a, b)], U)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(shingles)
    counts = np.add.reduceat(bits, row_start[full], axis=0, dtype=np.int64)
    majority = counts * 2 > shingles[full, None]
    out[full] = np.packbits(majority, axis=1, bitorder="little").view(U).reshape(-1)
    return out


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, and the text's hash by Spark as version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            yield pa.record_batch({"doc_id": part.column(0), "fingerprint": pa.array(fingerprints_of(part.column(1)).view(np.int64)), "version": part.column(2)})

    return documents.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, "doc_id long, fingerprint long, version long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j; 64 x 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy()
            for a in range(0, len(values), 8192):
                bits = np.unpackbits(values[a : a + 8192].astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.record_batch({"cell": pa.array(np.arange(BITS * BITS)), "n": pa.array(total.reshape(-1).astype(np.int64))})

    cells = distinct.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for cell, n in cells.collect():
        both[cell] = n
    return distinct.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Partitions of equal width: each starts with the free bit of most correlation and takes those nearest to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        own = [max(free, key=lambda b: (r[b, free].sum(), -b))]
        while len(own) < width:
            own.append(max((b for b in free if b not in own), key=lambda b: (r[b, own].sum(), -b)))
        free = [b for b in free if b not in own]
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 up with the given sum and the least cost; costs[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for (done, (cost, chosen)), t in product(best.items(), range(-1, len(own) - 1)):
            found = (cost + own[t + 1], [*chosen, t])
            if done + t not in nxt or found[0] < nxt[done + t][0]:
                nxt[done + t] = found
        best = nxt
    return best[total][1]


def thresholds(distinct: DataFrame, n: int, both: np.ndarray, parts: list[list[int]], distance: int) -> list[int]:
    """Least estimated candidates: pairs that agree in a partition are counted over all fingerprints; a
    threshold of t adds what t differing bits would, each at the odds that it differs."""
    frames = [
        distinct.groupBy((F.col("fingerprint").bitwiseAND(F.lit(signed(mask_of(bits))))).alias("v")).count().agg(F.lit(i).alias("i"), F.sum((F.col("count").cast("double") * (F.col("count") - 1) / 2)).alias("pairs"))
        for i, bits in enumerate(parts)
    ]
    counts = frames[0]
    for frame in frames[1:]:
        counts = counts.unionByName(frame)
    equal = {r.i: r.pairs or 0.0 for r in counts.collect()}
    p = np.diag(both) / max(n, 1)
    costs = []
    for i, bits in enumerate(parts):
        differs = np.minimum(2 * p[bits] * (1 - p[bits]), 0.49)
        odds = differs / (1 - differs)
        term = np.zeros(distance + 1)  # elementary symmetric sums
        term[0] = 1
        for o in odds:
            term[1:] += o * term[:-1].copy()
        probes = np.cumsum([1.0, len(bits), len(bits) * (len(bits) - 1) / 2, len(bits) ** 3 / 6][: distance + 1])
        costs.append([0.0, *(np.cumsum(term) * (equal[i] + 1) + probes * n)])
    return allocate(costs, distance - len(parts) + 1)


def _flips(bits: list[int], t: int) -> list[int]:
    """All masks of at most t of the bits, none first."""
    out = [0]
    for _ in range(t):
        out = list(dict.fromkeys(x ^ (1 << b) for x in out for b in [*bits] if not x >> b & 1) | dict.fromkeys(out))
    return sorted(out)


#: A bucket: the bits on which all its fingerprints agree and their value there, and of which near value it is (0: none).
KEY = ["mask", "value", "of"]


def probes(distinct: DataFrame, parts: list[list[int]], chosen: list[int]) -> DataFrame:
    keys = []
    for bits, t in zip(parts, chosen):
        if t < 0:
            continue
        mask = signed(mask_of(bits))
        value = F.col("fingerprint").bitwiseAND(F.lit(mask))
        if t == 0:
            keys.append(F.struct(F.lit(mask).alias("mask"), value.alias("value"), F.lit(0).cast("long").alias("of")))
            continue
        none = F.lit(0).cast("long")
        keys += [F.struct(none.alias("mask"), none.alias("value"), F.xxhash64(F.lit(mask), value.bitwiseXOR(F.lit(signed(x)))).alias("of")) for x in _flips(bits, t)]
    return distinct.select("rep", "fingerprint", F.explode(F.array(*keys)).alias("key")).select("key.*", "rep", "fingerprint")


def _fits(mask: int) -> bool:
    return BITS - (mask & (1 << 64) - 1).bit_count() <= 12


def _split_masks(mask: int, distance: int) -> list[int]:
    """The mask with each of distance + 1 shares of its free bits in turn."""
    full = mask & (1 << 64) - 1
    free = [b for b in range(BITS) if not full >> b & 1]
    return [signed(full | mask_of(free[k :: distance + 1])) for k in range(distance + 1)]


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def stars(key: np.ndarray, rep: np.ndarray, value: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, as a star to the least row of each linked group."""
    n = len(key)
    root = np.arange(n)
    ends = np.searchsorted(key, key, "right")
    step = 1
    live = np.flatnonzero(np.arange(n) + step < ends)
    while len(live):
        near = live[np.bitwise_count(value[live] ^ value[live + step]) <= distance]
        if len(near):
            a, b = root[near], root[near + step]
            apart = a != b
            if apart.any():
                root = _roots(a[apart], b[apart], n)[root]
        step += 1
        live = live[live + step < ends[live]]
    linked = np.flatnonzero(root != np.arange(n))
    return rep[root[linked]], rep[linked]


def verify(rows: DataFrame, distance: int) -> DataFrame:
    """Stars of links in each bucket; the rows of a bucket stand together, at most BUCKET of them."""

    def emit(held: pa.Table) -> Iterator[pa.RecordBatch]:
        new = np.zeros(len(held), bool)
        new[0] = True
        for column in (held[k].to_numpy() for k in KEY):
            new[1:] |= column[1:] != column[:-1]
        a, b = stars(np.cumsum(new), held["rep"].to_numpy(), held["fingerprint"].to_numpy().view(U), distance)
        if len(a):
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, both]).combine_chunks() if held is not None else both
            columns = [held[k].to_numpy() for k in KEY]
            other = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
            if len(other):  # the last bucket may go on
                cut = int(other[-1]) + 1
                yield from emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from emit(held)

    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, "fingerprint")
    return ordered.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of representatives that connect the same fingerprints as all links do."""
    n, both = bit_statistics(distinct)
    groups = group_bits(n, both, parts)
    rows = probes(distinct, groups, thresholds(distinct, n, both, groups, distance))
    found = None
    while True:
        large = checkpointed(rows.groupBy(*KEY).count().filter(F.col("count") > bucket).drop("count"))
        masks = [r.mask for r in large.select("mask").distinct().collect()]
        own = verify(rows.join(large, KEY, "left_anti") if masks else rows, distance)
        found = own if found is None else found.unionByName(own)
        if not masks:
            return found
        done = [m for m in masks if _fits(m)]
        rest = rows.join(large, KEY, "left_semi").distinct()
        if done:  # all their fingerprints differ in 12 bits at most
            found = found.unionByName(verify(rest.filter(F.col("mask").isin(done)), distance))
            rest = rest.filter(~F.col("mask").isin(done))
            masks = [m for m in masks if m not in done]
        if not masks:
            return found
        keys = None
        for mask in masks:
            finer = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value"), F.col("of").alias("of")) for m in _split_masks(mask, distance)])
            keys = F.when(F.col("mask") == mask, finer) if keys is None else keys.when(F.col("mask") == mask, finer)
        rows = checkpointed(rest.select("rep", "fingerprint", F.explode(keys).alias("key")).select("key.*", "rep", "fingerprint").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of an edge can reach, by large and small stars."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        # Large star: neighbours above a node link to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: neighbours below a node, and the node, link to the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        lower = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(lower.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def _grouped(made: DataFrame, distance: int) -> DataFrame:
    """Of (doc_id, fingerprint, version): a row for each fingerprint, with the number of its rows, its
    component_id and the representative of its component, as (null_id, doc_id, version)."""
    own = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "version")).alias("first")
    distinct = written(made.groupBy("fingerprint").agg(own, F.count("*").alias("copies")).withColumn("rep", F.col("fingerprint")), "distinct")
    found = components(links(distinct.select("rep", "fingerprint"), distance))
    named = distinct.join(found, distinct.rep == found.node, "left").select("fingerprint", "copies", "first", F.coalesce("component", "rep").alias("component"))
    first = named.groupBy("component").agg(F.min("first").alias("first"))
    return written(named.drop("first").join(first, "component").select("fingerprint", "copies", F.col("first.doc_id").alias("component_id"), "first"), "grouped")


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of its near-duplicates (null if none has one)."""
    made = written(fingerprints(documents), "fingerprints")
    named = split_join(made, _grouped(made, distance), ["fingerprint"], "copies")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents, with all their columns, that stand for their component.

    That is the one with the least doc_id; a document without doc_id only where none has one, then
    the one with the least hash of its text. Of rows that repeat it, one stays.
    """
    made = written(fingerprints(documents), "fingerprints")
    firsts = _grouped(made, distance).select("first.*").distinct()
    kept = firsts.select("null_id", F.coalesce("doc_id", F.lit(0)).alias("id"), "version")
    whole = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("version")
    )
    key = ["null_id", "id", "version"]
    number = F.row_number().over(W.partitionBy(*key).orderBy(*key))
    alone = whole.join(kept, key, "left_semi").withColumn("number", number).filter("number = 1")
    return alone.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])

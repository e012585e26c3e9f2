"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

The key of a line is the line without white space at its ends, A-Z lower-cased; keys of
``least_chars`` code points or more are watched, as 128-bit hashes. Documents are taken in
``BATCHES`` batches from the largest doc_id down. The state of the corpus so far is a list of
runs: tables of (key, keeper, documents, places), bucketed and sorted by key. Every key stands
in one run alone.

* A batch sums up its own lines by key and is merged with each run: buckets meet buckets, so only
  the batch is shuffled. Keys that stand in no run (the anti-join) are the new run; no later batch
  can hold a larger doc_id, so their keeper is final. Keys that stand in a run are tallied: they
  add to the counts and nothing else.
* Whenever ``FANOUT`` runs stand on one level they are merged into one of the next level, so a
  batch meets few runs and a key is rewritten once a level.

At the end, keys whose run and tallies count ``least_documents`` documents or more lose all lines
but those of the keeper. Line places meet those keys by ``split_join``, so that no key sends all its
places to one task. Texts are shuffled once, with the places to drop. Counts are summed before
every shuffle.

Cases: null and empty texts are one empty line; equal lines of one document count once; each
row counts as a document, and rows that share the largest doc_id all keep the line; rows
without a doc_id never are the keeper; empty tables give an empty result; only ``doc_id`` and
``text`` are read, other columns stay as they are whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import SortedBuckets, split_join, written

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
BATCHES, FANOUT = 6, 3
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the built-in lower() does just that where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def watched_lines(documents: DataFrame, least_chars: int) -> DataFrame:
    """A row for each watched line: its key, place, document, and whether it is the first of its key there."""
    stripped = F.transform(lines_of(F.col("text")), lambda line, i: F.struct(F.btrim(line, F.lit(SPACE)).alias("key"), i.alias("at")))
    long = F.filter(stripped, lambda x: F.char_length(x["key"]) >= least_chars)
    lowered = F.transform(long, lambda x: F.struct(ascii_lower(x["key"]).alias("key"), x["at"].alias("at")))
    hashed = F.array_sort(F.transform(lowered, lambda x: F.struct(F.xxhash64(x["key"]).alias("k1"), F.xxhash64(F.lit("line"), x["key"]).alias("k2"), x["at"].alias("at"))))
    own = documents.select("doc_id", F.xxhash64("text").alias("version"), hashed.alias("own")).filter(F.size("own") > 0)

    def first(x: Column, i: Column) -> Column:
        before = F.get(F.col("own"), i - 1)
        return F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["at"].alias("at"), ((i == 0) | (before["k1"] != x["k1"]) | (before["k2"] != x["k2"])).cast("long").alias("first"))

    return own.select("doc_id", "version", F.explode(F.transform("own", first)).alias("line")).select("doc_id", "version", "line.*")


class Runs:
    """Sorted runs on levels, and the tallies of keys that were met again."""

    def __init__(self, spark: SparkSession, fanout: int) -> None:
        self.fanout = fanout
        self.tables = SortedBuckets(spark, KEY)
        self.levels: list[list[DataFrame]] = []
        self.tallies: list[DataFrame] = []

    def __enter__(self) -> Runs:
        return self

    def __exit__(self, *_: object) -> None:
        self.tables.drop()

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def push(self, run: DataFrame, level: int = 0) -> None:
        """Adds a run; a full level is merged into the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.push(self.tables.write(_union(full), f"run{level + 1}"), level + 1)

    def add(self, batch: DataFrame) -> None:
        """Merges a batch's keys with all runs: the anti-join is a new run, the rest a tally."""
        known = F.lit(False)
        for number, run in enumerate(self.all()):
            batch = batch.join(run.select(*KEY, F.lit(True).alias(f"in{number}")).hint("merge"), KEY, "left")
            known |= F.col(f"in{number}").isNotNull()
        met = self.tables.write(batch.select(*KEY, "keeper", "documents", "places", known.alias("known")), "run0", "known")
        self.push(met.filter("NOT known").drop("known"))
        self.tallies.append(met.filter("known").select(*KEY, "documents", "places"))

    def counted(self) -> DataFrame:
        """Every key once, with its keeper, and its documents and places in the whole corpus."""
        again = _union(self.tallies).groupBy(*KEY).agg(F.sum("documents").alias("more"), F.sum("places").alias("elsewhere"))
        whole = _union(self.all()).join(again, KEY, "left")
        return whole.select(*KEY, "keeper", *[(F.col(own) + F.coalesce(F.col(other), F.lit(0))).alias(own) for own, other in (("documents", "more"), ("places", "elsewhere"))])


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def repeated_lines(lines: DataFrame, batches: int, fanout: int, least_documents: int) -> DataFrame:
    """Keys in enough documents that have a keeper, with it and the number of their places."""
    with Runs(lines.sparkSession, fanout) as runs:
        for number in range(batches):
            own = lines.filter(F.col("batch") == number)
            runs.add(own.groupBy(*KEY).agg(F.max("doc_id").alias("keeper"), F.sum("first").alias("documents"), F.count("*").alias("places")))
        repeated = runs.counted().filter((F.col("documents") >= least_documents) & F.col("keeper").isNotNull())
        return written(repeated.select(*KEY, "keeper", "places"), "repeated")


def with_kept_text(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Struct ``row``, a whole document, with struct ``deduplicated``: kept text, lines before, lines dropped."""
    ids = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (ids[0] or 0, ids[1] or 0)
    width = (high - low) // batches + 1
    batch = F.coalesce(F.lit(batches - 1) - F.floor((F.col("doc_id") - low) / width), F.lit(batches - 1)).cast("int")
    lines = written(watched_lines(documents.select("doc_id", "text"), least_chars).withColumn("batch", batch), "lines", "batch")
    repeated = repeated_lines(lines, batches, fanout, least_documents)
    places = split_join(lines.select(*KEY, "doc_id", "version", "at"), repeated, KEY, "places")
    dropped = places.filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    drops = dropped.groupBy("doc_id", "version").agg(F.array_distinct(F.collect_list("at")).alias("drop"))
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    joined = whole.join(drops, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("version")), "left")
    joined = joined.select("row", "drop", lines_of(F.col("row.text")).alias("lines"))
    kept = F.when(F.col("drop").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get(F.col("lines"), i)), "\n")
    )
    n_dropped = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop"))
    return joined.select("row", F.struct(kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped")).alias("deduplicated"))


def line_dedup(documents: DataFrame, **options: int) -> DataFrame:
    """The documents with the kept text in place of the text, and n_chars, if there is one, to match."""
    made = with_kept_text(documents, **options)
    text = F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).otherwise(F.col("deduplicated.text"))
    changed = {"text": text, "n_chars": F.char_length(text)}
    return made.select(*[changed[c].cast(documents.schema[c].dataType).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in documents.columns])


def digest(documents: DataFrame, **options: int) -> DataFrame:
    return with_kept_text(documents.select("doc_id", "text"), **options).select(
        "row.doc_id", "deduplicated.n_lines", "deduplicated.n_dropped", F.sha2(F.col("deduplicated.text"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, hot.k IS NOT NULL AND l.doc_id <> hot.keeper AS dropped FROM l LEFT JOIN hot ON l.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

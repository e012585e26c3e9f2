"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``TABLE`` lists (name, measure, least, most). Measures are expressions over the words, lines
and symbols of a text; :func:`verdict` turns the table into one Boolean column and
:func:`reasons` into an array of the names of failing rules. Everything runs row by row where
the text lies: nothing is shuffled.

Repeats of five-word windows are found with 64-bit hashes: most texts have none, which a
hash set tells; only in the others are (hash, place) pairs sorted.

Cases: null and empty texts have no words and fail; lines without a word never count as
duplicates; repeated rows are judged each on its own; other columns are kept and none is
shadowed; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.line_dedup import lines_of

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Frequent words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au de des du en est et la le les ne pas pour que qui un une "
    "das dem den der die ein eine ich im ist nicht sich und von zu "
    "con del el es lo los no por que se su una y"
).split()

#: (rule, measure, least, most); None is no bound (fixed values).
TABLE: list[tuple[str, str, float | None, float | None]] = [
    ("words", "n_words", 10, None),
    ("mean word length", "mean_word_chars", 2, 25),
    ("longest word", "longest_word", None, 1000),
    ("symbols to words", "symbols_per_word", None, 0.3),
    ("capital words", "upper_words", None, 0.6),
    ("exclamations to words", "marks_per_word", None, 0.5),
    ("duplicate lines", "dup_line_share", None, 0.5),
    ("words with letters", "letter_words", 0.5, None),
    ("bullet lines", "bullet_lines", None, 0.95),
    ("distinct words", "distinct_words", 0.02, None),
    ("stop words", "stop_words", None, 0.95),
    ("words after themselves", "echo_words", None, 0.4),
]

_PREFIX = "__quality_"


def _c(name: str) -> Column:
    return F.col(_PREFIX + name)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _repeats(hashes: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """(hash, place) of all windows, sorted, where any two are equal; and the test that a neighbour is equal."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(x: Column, k: Column) -> Column:
        sorted_ = _c("sorted")
        return ((k > 0) & (F.get(sorted_, k - 1)["h"] == x["h"])) | F.coalesce(F.get(sorted_, k + 1)["h"] == x["h"], F.lit(False))

    return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), placed), repeated


def measured(documents: DataFrame) -> DataFrame:
    """The documents with the measures of ``TABLE`` and of the base contract in prefixed columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = documents.withColumn(_PREFIX + "words", _words(F.col("text")))
    words = _c("words")
    n = F.size(words)
    second = first.withColumns(
        {
            _PREFIX + "n_words": n.cast("long"),
            _PREFIX + "word_hashes": F.transform(words, lambda w: F.xxhash64(w)),
            _PREFIX + "lines": F.filter(lines_of(F.col("text")), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            _PREFIX + "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            _PREFIX + "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.char_length(w)),
            _PREFIX + "upper": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0Da-z]*[A-Z][A-Z][^\x20\x09-\x0Da-z]*+(?![^\x20\x09-\x0D])")).cast("long"),
            _PREFIX + "marks": F.regexp_count(text, F.lit(r"[!?]{2}")).cast("long"),
            _PREFIX + "lettered": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+")).cast("long"),
            _PREFIX + "stops": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            _PREFIX + "longest": F.coalesce(F.array_max(F.transform(words, lambda w: F.char_length(w))), F.lit(0)),
        }
    )
    wh = _c("word_hashes")
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))
    echoes = F.filter(wh, lambda h, i: (i > 0) & (F.get(wh, i - 1) == h))
    third = second.withColumn(_PREFIX + "windows", windows).withColumn(_PREFIX + "echoes", F.size(echoes)).withColumn(_PREFIX + "distinct", F.size(F.array_distinct(wh)))
    placed, repeated = _repeats(_c("windows"))
    fourth = third.withColumn(_PREFIX + "sorted", placed)
    at = F.array_sort(F.transform(F.filter(_c("sorted"), repeated), lambda x: x["i"]))
    fifth = fourth.withColumn(_PREFIX + "at", at)
    places = _c("at")
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    lines, words_ = _c("lines"), F.greatest(_c("n_words"), F.lit(1))
    return fifth.withColumns(
        {
            _PREFIX + "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            _PREFIX + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            _PREFIX + "mean_word_chars": _c("word_chars") / words_,
            _PREFIX + "longest_word": _c("longest"),
            _PREFIX + "symbols_per_word": _c("n_symbols") / words_,
            _PREFIX + "upper_words": _c("upper") / words_,
            _PREFIX + "marks_per_word": _c("marks") / words_,
            _PREFIX + "letter_words": _c("lettered") / words_,
            _PREFIX + "distinct_words": _c("distinct") / words_,
            _PREFIX + "stop_words": _c("stops") / words_,
            _PREFIX + "echo_words": _c("echoes") / words_,
            _PREFIX + "bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))) / F.greatest(F.size(lines), F.lit(1)),
        }
    ).withColumn(_PREFIX + "dup_line_share", _c("n_dup_lines") / F.greatest(F.size(lines), F.lit(1)))


def _fails(measure: str, least: float | None, most: float | None) -> Column:
    bad = F.lit(False)
    if least is not None:
        bad = bad | (_c(measure) < least)
    if most is not None:
        bad = bad | (_c(measure) > most)
    return bad


def verdict(table: list[tuple[str, str, float | None, float | None]] = TABLE) -> Column:
    """True where no rule of the table fails."""
    failed = F.lit(False)
    for _, measure, least, most in table:
        failed = failed | _fails(measure, least, most)
    return ~failed


def reasons(table: list[tuple[str, str, float | None, float | None]] = TABLE) -> Column:
    return F.array_compact(F.array(*[F.when(_fails(m, a, b), F.lit(name)) for name, m, a, b in table]))


def base_failed() -> Column:
    return (_c("n_words") < MIN_WORDS) | (100 * _c("n_repeat_words") > MAX_REPEAT_PERCENT * _c("n_words"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents, with their columns, that pass the base rule and the table.

    The row number keeps the filter above the projections; pushed below, it would repeat them.
    """
    own = [f"`{c}`" for c in documents.columns]
    judged = measured(documents).select(*own, (~base_failed() & verdict()).alias(_PREFIX + "kept"), F.monotonically_increasing_id().alias(_PREFIX + "row"))
    return judged.filter(_c("kept") & (_c("row") >= 0)).select(*own)


def digest(documents: DataFrame) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made = measured(documents.select("doc_id", "text"))
    return made.select("doc_id", *[_c(b).alias(b) for b in base], base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"))


def oracle_sql(table: list[tuple[str, str, float | None, float | None]] = TABLE) -> str:
    """The digest in SQL, over one row a word."""
    fails = " OR ".join(f"{m} {op} {bound!r}" for _, m, a, b in table for op, bound in (("<", a), (">", b)) if bound is not None)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (
  SELECT *, string_agg(word, ' ') OVER f AS h, count(*) OVER f AS n, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), s AS (SELECT *, n = 5 AND count(*) OVER (PARTITION BY doc_id, h, n) > 1 AS starts FROM g),
c AS (SELECT *, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM s),
m AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words, max(length(word)) AS longest_word,
         count(*) FILTER (WHERE regexp_matches(word, '[A-Z][A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS uppers, count(*) FILTER (WHERE regexp_matches(word, '\p{{L}}')) AS letters,
         count(DISTINCT word) AS kinds, count(*) FILTER (WHERE lower(word) IN ({stops})) AS stops, count(*) FILTER (WHERE word = before) AS echoes
  FROM c GROUP BY doc_id
), a AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(longest_word, 0) AS longest_word,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, greatest(coalesce(n_words, 0), 1) AS one, greatest(len(l), 1) AS lines,
         coalesce(uppers, 0) AS uppers, coalesce(letters, 0) AS letters, coalesce(kinds, 0) AS kinds, coalesce(stops, 0) AS stops, coalesce(echoes, 0) AS echoes,
         len(regexp_extract_all(text, '[!?]{{2}}')) AS marks, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id
), r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, word_chars / one AS mean_word_chars, n_symbols / one AS symbols_per_word, uppers / one AS upper_words,
         marks / one AS marks_per_word, n_dup_lines / lines AS dup_line_share, letters / one AS letter_words, bullets / lines AS bullet_lines, kinds / one AS distinct_words, stops / one AS stop_words, echoes / one AS echo_words
  FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept FROM r
"""

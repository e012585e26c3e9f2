"""The comparison over sheets of short labelled fields, where SQL can follow every step: queries and their SQL.

The SQL states its weights, cuts and patterns itself, so it checks those of the library too.
Common subsequences are found as the library does not: each pair alone, by bits of a 128-bit
number, for all distinct pairs of strings at once. Assignments are the best of all that exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import CompareConfig
from palimpsest.functions import similarity
from palimpsest.functions.lines import normalized
from palimpsest.operators import classify, compare, matching, textdiff
from palimpsest.plans import sinks
from palimpsest.scratch import checkpointed, merged
from palimpsest.sources import fixtures

SERVICE = CompareConfig.service()
STRICTNESS = 0.92


def _scaled(c: Column) -> Column:
    return F.floor(c * 10_000 + 0.5).cast("long")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    source = fixtures.spread(fixtures.sheets(fixtures.table(spark, sf, "part")))
    return source, fixtures.revised_sheets(source)


def _fields(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    source, target = _sides(spark, sf)
    return fixtures.sheet_fields(source, "s"), fixtures.sheet_fields(target, "t")


def sheet_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """All similarities of all pairs of values of a sheet."""

    def side(df: DataFrame, n: str) -> DataFrame:
        """What depends on one value alone, once a value and not once a pair."""
        text = F.col(n)
        made = {f"{n}_sorted": similarity.sorted_tokens(text), f"{n}_set": similarity.token_set(text), f"{n}_alnum": similarity.alphanumeric_set(text)}
        return matching.dealt(df.select("pair_id", F.col("ord").alias(f"{n}_ord"), normalized(F.col("value")).alias(n)), "pair_id").withColumns(made)

    source, target = (side(x, n) for x, n in zip(_sides(spark, sf), "ab"))
    met = source.join(merged(target), "pair_id").withColumns(similarity.token_parts(F.col("a_set"), F.col("b_set")))
    empty = (F.size("a_set") == 0) | (F.size("b_set") == 0)
    scores = {
        "ratio": similarity.ratio("a", "b"), "token_sort": similarity.ratio("a_sorted", "b_sorted"), "own": similarity.ratio("own_x", "own_y"),
    }
    scored = met.withColumns(scores).withColumn("token_set", similarity.token_set_from(empty, F.col("shared"), F.col("own_x"), F.col("own_y"), F.col("own")))
    made = {
        "ratio": F.col("ratio") / 100, "token_sort": F.col("token_sort") / 100, "token_set": F.col("token_set") / 100,
        "text_similarity": similarity.text_similarity_from(F.col("a"), F.col("b"), F.col("ratio"), F.col("token_sort")), "token_overlap": similarity.overlap_of(F.col("a_alnum"), F.col("b_alnum"), F.col("token_set")),
    }
    return scored.select("pair_id", "a_ord", "b_ord", *[_scaled(c).alias(n) for n, c in made.items()])


def sheet_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs with their signals."""
    names = ("label_similarity", "value_similarity", "token_overlap", "regex_compatibility", "composite")
    return matching.candidates(*_fields(spark, sf), SERVICE).select("pair_id", "s_ord", "t_ord", *[_scaled(F.col(n)).alias(n) for n in names])


def sheet_assignment(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _fields(spark, sf)
    return matching.assign(checkpointed(matching.contenders(source, target, SERVICE)), source, target, SERVICE)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare(*_fields(spark, sf), SERVICE, cut=checkpointed)


def sheet_results(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes in the order of results."""
    rows = compare.ordered_results(_results(spark, sf))
    return rows.select("pair_id", F.col("result_ord").cast("long").alias("result_ord"), "s_ord", "t_ord", "match_type", _scaled(F.col("confidence")).alias("confidence"))


def sheet_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = classify.flags(classify.with_certainties(_results(spark, sf)))
    return rows.select("pair_id", "field_reference", "type", "severity", _scaled(F.col("confidence")).alias("confidence"))


def sheet_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The reasons of outcomes as text."""
    return _results(spark, sf).select("pair_id", "s_ord", "t_ord", "reason")


def sheet_flag_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The reasons of flags as text, in the order of a report."""
    rows = classify.ordered(classify.flags(classify.with_certainties(_results(spark, sf))))
    return rows.select("pair_id", "field_reference", "type", "reason")


def sheet_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the JSON report of each sheet holds: counts, rows of sections, flags."""
    results = _results(spark, sf)
    rows = sinks.json_reports(results, classify.summary(results), classify.flags(classify.with_certainties(results)))
    get = lambda path: F.get_json_object("report", path)
    size = lambda path: F.coalesce(F.json_array_length(get(path)), F.lit(0)).cast("long")
    return rows.select(
        "pair_id", get("$.schema_version").alias("version"), get("$.summary.matched").cast("long").alias("matched"), *[size(f"$.sections.{n}").alias(n) for n in ("changed", "partial", "missing", "extra", "uncertain")],
        size("$.flags").alias("flags"), get("$.sections.missing[0].s_field_id").alias("first_missing"),
    )


def sheet_summary(spark: SparkSession, sf: str) -> DataFrame:
    return classify.summary(_results(spark, sf))


def sheet_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential links and their older classification."""
    sides = [x.withColumn("key", F.col("normalized_value")) for x in _fields(spark, sf)]
    return classify.legacy_results(*sides, matching.sequential_links(*sides)).select("pair_id", "s_ord", "t_ord", _scaled(F.col("score") / 100).alias("score"), "match_type")


def _difference(spark: SparkSession, sf: str) -> DataFrame:
    source, target = (x.select("pair_id", "ord", F.lit(1).alias("page"), F.col("value").alias("text"), normalized(F.col("value")).alias("normalized")) for x in _sides(spark, sf))
    return textdiff.difference(source, target, STRICTNESS, cut=checkpointed)


def sheet_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy links, and what they leave, with categories and risks."""
    return _difference(spark, sf).select("pair_id", "kind", "s_ord", "t_ord", _scaled(F.col("score") / 100).alias("score"), "category", F.col("risk").cast("long").alias("risk"))


def sheet_difference_summary(spark: SparkSession, sf: str) -> DataFrame:
    return textdiff.summary(_difference(spark, sf))


def sheet_recap(spark: SparkSession, sf: str) -> DataFrame:
    rows = textdiff.recap(_difference(spark, sf))
    return rows.select("pair_id", F.col("rank").cast("long").alias("rank"), "kind", "category", F.col("risk").cast("long").alias("risk"), "source_snippet", "target_snippet")


QUERIES = {
    f.__name__: f
    for f in (
        sheet_ratios, sheet_breakdown, sheet_assignment, sheet_results, sheet_reasons, sheet_flags, sheet_flag_reasons, sheet_report, sheet_summary, sheet_legacy, sheet_differences, sheet_difference_summary, sheet_recap,
    )
}

FIELDS = """rows0 AS (
  SELECT p_partkey AS pair_id, unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['Part Name', 'Brand', 'Type', 'Size', '', 'Issued']) AS label,
    unnest([p_name, p_brand, p_type, p_size || ' x ' || (p_size + 3), 'price ' || (p_partkey % 100) || '.' || p_size,
            '2024-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0')]) AS value FROM part
), k0 AS (SELECT *, (pair_id * 7 + ord * 3) % 10 AS k FROM rows0), rows1 AS (
  SELECT pair_id, ord, CASE WHEN k = 4 THEN label || ' no' ELSE label END AS label,
    CASE k WHEN 1 THEN value || ' REV B' WHEN 2 THEN replace(value, 'e', '3') WHEN 5 THEN reverse(value) ELSE value END AS value FROM k0 WHERE k <> 0
  UNION ALL SELECT pair_id, ord + 100, 'Note', 'added ' || ord FROM k0 WHERE k = 3
), s AS (SELECT pair_id::BIGINT AS pair_id, ord::BIGINT AS ord, label, value, trim(lower(label)) AS nl, trim(lower(value)) AS nv FROM rows0),
t AS (SELECT pair_id::BIGINT AS pair_id, ord::BIGINT AS ord, label, value, trim(lower(label)) AS nl, trim(lower(value)) AS nv FROM rows1)"""
WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
SORTED = f"array_to_string(list_sort({WORDS}), ' ')"
ALNUM = "list_distinct(regexp_extract_all({0}, '[a-z0-9]+'))"
KIND = r"""CASE WHEN regexp_matches({0}, '\b\d{{4}}-\d{{2}}-\d{{2}}\b') THEN 'ISO_DATE' WHEN regexp_matches({0}, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b') THEN 'US_DATE'
  WHEN regexp_matches({0}, '\b\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?\b', 'i') THEN 'DIMENSION' WHEN regexp_matches({0}, '\b\d+\.\d+\b') THEN 'DECIMAL' WHEN regexp_matches({0}, '\b\d+\b') THEN 'INTEGER' END"""
S4 = "floor(({0}) * 10000 + 0.5)::BIGINT"


def common(strings: str) -> str:
    """CTE ``rt``: the ratio of each distinct pair (a, b) of a query's strings; b's characters step through a number whose bits are a's places."""
    return f"""strings AS ({strings}), ab AS (SELECT DISTINCT a, b FROM strings),
places AS (SELECT a, map_from_entries(list_transform(list_distinct(string_split(a, '')), lambda c: struct_pack(k := c, v := list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = c THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END))::HUGEINT))) AS mask
  FROM (SELECT DISTINCT a FROM ab) WHERE a <> ''),
steps AS (SELECT a, b, (1::HUGEINT << length(a)::INTEGER) - 1 AS whole, list_transform(string_split(b, ''), lambda c: coalesce(mask[c], 0::HUGEINT)) AS hits FROM ab JOIN places USING (a) WHERE b <> ''),
rt AS (
  SELECT a, b, 200e0 * (length(a) - bit_count(list_reduce(hits, lambda v, h: ((v + (v & h)) | (v - (v & h))) & whole, whole))::BIGINT) / (length(a) + length(b)) AS r FROM steps
  UNION ALL SELECT a, b, CASE WHEN a = b THEN 100e0 ELSE 0e0 END FROM ab WHERE a = '' OR b = '')"""


def similarities(a: str, b: str, pairs: str) -> str:
    """CTEs from ``pairs`` (pair_id, i, j and strings a and b): ``sim`` with all similarities; both sides' token sets come from a and b."""
    return f"""pairs AS ({pairs}),
toks AS (SELECT *, {SORTED.format('a')} AS sa, {SORTED.format('b')} AS sb, list_sort(list_distinct({WORDS.format(a)})) AS wa, list_sort(list_distinct({WORDS.format(b)})) AS wb, {ALNUM.format(a)} AS na, {ALNUM.format(b)} AS nb FROM pairs),
sets AS (SELECT *, array_to_string(list_filter(wa, lambda x: list_contains(wb, x)), ' ') AS shared, array_to_string(list_filter(wa, lambda x: NOT list_contains(wb, x)), ' ') AS xa, array_to_string(list_filter(wb, lambda x: NOT list_contains(wa, x)), ' ') AS xb FROM toks),
ends AS (SELECT *, trim(shared || ' ' || xa) AS fa, trim(shared || ' ' || xb) AS fb FROM sets)"""


TOKEN_SET = """CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0e0 WHEN shared <> '' AND (xa = '' OR xb = '') THEN 100e0
  ELSE greatest(rf.r, CASE WHEN shared <> '' THEN 200e0 * length(shared) / (length(shared) + length(fa)) ELSE 0 END, CASE WHEN shared <> '' THEN 200e0 * length(shared) / (length(shared) + length(fb)) ELSE 0 END) END"""
JACCARD = "CASE WHEN len(na) = 0 AND len(nb) = 0 THEN 1e0 ELSE len(list_intersect(na, nb))::DOUBLE / greatest(len(list_distinct(list_concat(na, nb))), 1) END"
OVERLAP = f"CASE WHEN len(na) = 0 AND len(nb) = 0 THEN 1e0 WHEN len(na) = 0 OR len(nb) = 0 THEN 0e0 ELSE least(1e0, 0.5e0 * ({JACCARD}) + ts / 200) END"
_TEXT = "CASE WHEN {0} = '' AND {1} = '' THEN 1e0 WHEN {0} = '' OR {1} = '' THEN 0e0 ELSE greatest({2}, {3}) / 100 END"

RATIOS = f"""WITH {FIELDS}, {similarities('a', 'b', 'SELECT s.pair_id, s.ord AS i, t.ord AS j, s.nv AS a, t.nv AS b FROM s JOIN t USING (pair_id)')},
{common("SELECT a, b FROM ends UNION ALL SELECT sa, sb FROM ends UNION ALL SELECT fa, fb FROM ends")},
m AS (SELECT e.*, r0.r AS r0, r1.r AS r1, {TOKEN_SET} AS ts FROM ends e JOIN rt r0 ON r0.a = e.a AND r0.b = e.b JOIN rt r1 ON r1.a = sa AND r1.b = sb JOIN rt rf ON rf.a = fa AND rf.b = fb)
SELECT pair_id, i AS a_ord, j AS b_ord, {S4.format('r0 / 100')} AS ratio, {S4.format('r1 / 100')} AS token_sort, {S4.format('ts / 100')} AS token_set, {S4.format(_TEXT.format('a', 'b', 'r0', 'r1'))} AS text_similarity, {S4.format(OVERLAP)} AS token_overlap FROM m"""

SIGNALS = f"""{FIELDS}, {similarities("trim(la || ' ' || a)", "trim(lb || ' ' || b)", 'SELECT s.pair_id, s.ord AS i, t.ord AS j, s.nv AS a, t.nv AS b, s.nl AS la, t.nl AS lb FROM s JOIN t USING (pair_id)')},
full_ends AS (SELECT *, {SORTED.format('la')} AS sla, {SORTED.format('lb')} AS slb, {KIND.format('a')} AS ka, {KIND.format('b')} AS kb FROM ends),
{common("SELECT a, b FROM full_ends UNION ALL SELECT sa, sb FROM full_ends UNION ALL SELECT fa, fb FROM full_ends UNION ALL SELECT la, lb FROM full_ends UNION ALL SELECT sla, slb FROM full_ends")},
m AS (SELECT e.*, {_TEXT.format('e.a', 'e.b', 'r0.r', 'r1.r')} AS vs, {_TEXT.format('la', 'lb', 'r2.r', 'r3.r')} AS ls, la = '' AND lb = '' AS bare, {TOKEN_SET} AS ts
  FROM full_ends e JOIN rt r0 ON r0.a = e.a AND r0.b = e.b JOIN rt r1 ON r1.a = sa AND r1.b = sb JOIN rt rf ON rf.a = fa AND rf.b = fb JOIN rt r2 ON r2.a = la AND r2.b = lb JOIN rt r3 ON r3.a = sla AND r3.b = slb),
w AS (SELECT *, {OVERLAP} AS tov, CASE WHEN ka IS NULL AND kb IS NULL THEN 0.75e0 WHEN ka IS NULL OR kb IS NULL THEN 0.5e0 WHEN ka = kb THEN 1e0 ELSE 0.35e0 END AS rc FROM m),
scored AS (SELECT *, CASE WHEN bare THEN 0e0 ELSE 0.45e0 END * ls + CASE WHEN bare THEN {0.35 / 0.55!r}::DOUBLE ELSE 0.35e0 END * vs + CASE WHEN bare THEN {0.12 / 0.55!r}::DOUBLE ELSE 0.12e0 END * tov + CASE WHEN bare THEN {0.08 / 0.55!r}::DOUBLE ELSE 0.08e0 END * rc AS total FROM w),
cand AS (SELECT * FROM scored WHERE total >= 0.4e0)"""

LINKS = f"""{SIGNALS}, sizes AS (SELECT pair_id, n, m FROM (SELECT pair_id, count(*) AS n FROM s GROUP BY 1) LEFT JOIN (SELECT pair_id, count(*) AS m FROM t GROUP BY 1) USING (pair_id)),
edge AS (SELECT pair_id, i, j, round(least(1e0, greatest(0e0, total)) * 1000000)::BIGINT AS w, 1::BIGINT << (dense_rank() OVER (PARTITION BY pair_id ORDER BY j) - 1)::INTEGER AS bit FROM cand
  UNION ALL SELECT pair_id, ord, NULL, 0, 0 FROM s),
walk AS (SELECT pair_id, 0::BIGINT AS step, 0::BIGINT AS used, 0 AS k, 0::BIGINT AS w, []::BIGINT[] AS js FROM sizes
  UNION ALL SELECT pair_id, step + 1, used | bit, k + (j IS NOT NULL)::INTEGER, walk.w + edge.w, list_append(js, j) FROM walk JOIN edge USING (pair_id) WHERE edge.i = step AND used & bit = 0),
best AS (SELECT pair_id, js FROM walk JOIN sizes USING (pair_id) WHERE step = n QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY least(k, least(n, coalesce(m, 0)) - 1) DESC, w DESC, k DESC) = 1),
link AS (SELECT pair_id, i, j FROM (SELECT pair_id, unnest(range(len(js))) AS i, unnest(js) AS j FROM best) WHERE j IS NOT NULL)"""

RESULTS = f"""{LINKS}, linked AS (
  SELECT *, CASE WHEN bare THEN CASE WHEN vs >= 0.92 THEN 'exact_match' WHEN vs <= 0.9 AND total >= 0.65 THEN 'changed_value' WHEN total >= 0.65 THEN 'partial_match' WHEN total <= 0.55 THEN 'uncertain' ELSE 'partial_match' END
    WHEN ls >= 0.92 AND vs >= 0.92 THEN 'exact_match' WHEN ls >= 0.75 AND vs <= 0.9 THEN 'changed_value' WHEN ls >= 0.75 AND vs < 0.92 THEN 'partial_match' WHEN total >= 0.65 THEN 'partial_match' ELSE 'uncertain' END AS kind,
    least(1e0, greatest(0e0, total)) AS base FROM scored JOIN link USING (pair_id, i, j)
), results AS (
  SELECT pair_id, i AS s_ord, j AS t_ord, kind, CASE kind WHEN 'exact_match' THEN greatest(base, least(1e0, (ls + vs) / 2)) WHEN 'changed_value' THEN greatest(0e0, least(1e0, 0.55e0 + 0.45e0 * ls)) WHEN 'partial_match' THEN greatest(0e0, least(1e0, 0.45e0 + 0.55e0 * base))
    WHEN 'uncertain' THEN greatest(0e0, least(1e0, 0.35e0 + 0.4e0 * base)) ELSE base END AS conf,
    format('classification={{}}; normalized_label_similarity={{:.3f}}; normalized_value_similarity={{:.3f}}; token_overlap={{:.3f}}; regex_compatibility={{:.3f}}; composite={{:.3f}}', kind, ls, vs, tov, rc, total) AS reason FROM linked
  UNION ALL SELECT pair_id, ord, NULL, 'missing_in_target', 1e0, 'classification=missing_in_target' FROM s WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.pair_id = s.pair_id AND link.i = s.ord)
  UNION ALL SELECT pair_id, NULL, ord, 'extra_in_target', 1e0, 'classification=extra_in_target' FROM t WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.pair_id = t.pair_id AND link.j = t.ord)
)"""

FLAGS = f"""{RESULTS}, f AS (
  SELECT r.*, s.nl AS nl_s, t.nl AS nl_t, coalesce('s:' || r.pair_id || ':' || s_ord, 't:' || r.pair_id || ':' || t_ord) AS reference,
    CASE WHEN s.nv = '' AND t.nv = '' THEN 1e0 WHEN s.nv = '' OR t.nv = '' THEN 0e0 ELSE rv.r / 100 END AS v,
    CASE WHEN s.nl <> '' AND t.nl <> '' THEN rl.r / 100 WHEN s.nl <> '' OR t.nl <> '' THEN 0.38e0 ELSE 0.78e0 END AS l
  FROM results r LEFT JOIN s ON s.pair_id = r.pair_id AND s.ord = s_ord LEFT JOIN t ON t.pair_id = r.pair_id AND t.ord = t_ord LEFT JOIN rt rv ON rv.a = s.nv AND rv.b = t.nv LEFT JOIN rt rl ON rl.a = s.nl AND rl.b = t.nl
), g AS (SELECT *, 1 - least(v, l) AS weakest, (1 - v) * (0.45e0 + 0.35e0 * conf) + CASE WHEN l >= 0.88 THEN 0.2e0 ELSE 0e0 END AS delta, (1 - conf) * 0.55e0 + (1 - least(v, l)) * 0.45e0 AS doubt, 1 - least(v, l) + (1 - conf) * 0.35e0 AS part FROM f),
first AS (
  SELECT pair_id, reference, CASE kind WHEN 'missing_in_target' THEN 'missing_information' WHEN 'extra_in_target' THEN 'extra_information' WHEN 'changed_value' THEN 'changed_value' ELSE 'ambiguous_match' END AS type,
    CASE kind WHEN 'missing_in_target' THEN CASE WHEN s_ord = 0 THEN 'high' WHEN nl_s <> '' THEN 'medium' ELSE 'low' END
      WHEN 'extra_in_target' THEN CASE WHEN t_ord = 0 THEN 'medium' ELSE 'low' END
      WHEN 'changed_value' THEN CASE WHEN delta >= 0.4e0 + 0.2e0 THEN CASE WHEN conf < 0.55 THEN 'medium' ELSE 'high' END WHEN delta >= 0.15e0 + 0.15e0 THEN 'medium' ELSE 'low' END
      WHEN 'uncertain' THEN CASE WHEN conf <= 0.42 OR doubt >= 0.58e0 THEN 'high' WHEN doubt >= 0.38e0 THEN 'medium' ELSE 'low' END
      ELSE CASE WHEN part >= 0.62e0 THEN 'high' WHEN part >= 0.42e0 OR l < 0.72 THEN 'medium' ELSE 'low' END END AS severity, conf
  FROM g WHERE kind <> 'exact_match'
), flag AS (SELECT * FROM first UNION ALL
  SELECT pair_id, reference, 'possible_error', CASE WHEN 1 - conf >= 0.38e0 THEN 'high' WHEN 1 - conf >= 0.22e0 THEN 'medium' ELSE 'low' END, least(1e0, greatest(0e0, 1 - conf)) FROM g WHERE kind NOT IN ('missing_in_target', 'extra_in_target') AND conf < 0.55)"""
LEGACY = f"""{FIELDS}, keyed AS (SELECT s.pair_id, s.ord AS i, t.ord AS j, {SORTED.format('s.nv')} AS a, {SORTED.format('t.nv')} AS b, s.nv = t.nv AS equal FROM s JOIN t USING (pair_id)),
{common("SELECT a, b FROM keyed")}, e AS (SELECT keyed.*, r, 1::BIGINT << (dense_rank() OVER (PARTITION BY pair_id ORDER BY j) - 1)::INTEGER AS bit FROM keyed JOIN rt USING (a, b)),
walk AS (SELECT DISTINCT pair_id, 0::BIGINT AS step, 0::BIGINT AS used, NULL::BIGINT AS j, NULL::DOUBLE AS r, NULL::BOOLEAN AS equal FROM s
  UNION ALL SELECT w.pair_id, w.step + 1, w.used | coalesce(e.bit, 0), e.j, e.r, e.equal FROM walk w LEFT JOIN e ON e.pair_id = w.pair_id AND e.i = w.step AND w.used & e.bit = 0 WHERE w.step < 6
  QUALIFY row_number() OVER (PARTITION BY w.pair_id ORDER BY e.r DESC NULLS LAST, e.j) = 1)
SELECT pair_id, step - 1 AS s_ord, j AS t_ord, {S4.format('r / 100')} AS score, CASE WHEN equal THEN 'exact_match' WHEN r >= 92 THEN 'partial_match' WHEN r >= 75 THEN 'changed_value' WHEN r >= 55 THEN 'uncertain' ELSE 'changed_value' END AS match_type FROM walk WHERE j IS NOT NULL
UNION ALL SELECT pair_id, step - 1, NULL, NULL, 'missing_in_target' FROM walk WHERE step > 0 AND j IS NULL
UNION ALL SELECT pair_id, NULL, ord, NULL, 'extra_in_target' FROM t WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.pair_id = t.pair_id AND walk.j = t.ord)"""


def _has(*patterns: str) -> str:
    return "regexp_matches(blob, '" + "|".join(patterns).replace("'", "''") + "', 'is')"


#: Patterns of categories, as far as they can occur in short ASCII values (fixed values).
CATEGORY = f"""CASE WHEN {_has(r"[0-9]+[ ]*['’′]", r'[0-9]+[ ]*["”″]', r"[0-9]+(?:[.][0-9]+)?[ ]*[x×][ ]*[0-9]+(?:[.][0-9]+)?", r"\b[0-9]+(?:[.][0-9]+)?[ ]*(?:mm|cm|m|ft|in|inch|inches|deg|degrees|dia|diameter|radius)\b", r"\b(?:elevation|slope|grade)\b.*[0-9]", r"\bel[.]\b.*[0-9]", r"^[ ]*[-0-9. '/–—°" + '"' + "]{2,}[ ]*$")} THEN 'dimension'
  WHEN {_has(r"\b[0-9]{1,2}[ ]*[-/][ ]*[0-9]{1,2}[ ]*[-/][ ]*[0-9]{2,4}\b", r"\b[0-9]{4}[ ]*[-/][ ]*[0-9]{1,2}[ ]*[-/][ ]*[0-9]{1,2}\b", r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[ ]+[0-9]{1,2}(?:,?[ ]*[0-9]{4})?\b")} THEN 'date'
  WHEN {_has(r"\b(?:rev|revision|revisions|status|ifc|fcd|afc|for[ ]+construction|as[- ]+built|issued|construction[ ]+admin)\b", r"\bissue[ ]*#\b", r"\brev[ ]*[.:]?[ ]*[a-z0-9]{1,6}\b")} THEN 'revision_status'
  WHEN {_has(r"\b[a-z]{2,12}[-_/][0-9]{2,8}\b", r"\b[a-z]{2,12}[ ]*#[ ]*[0-9]+\b", r"\b(?:dwg|drawing|sheet|sht|detail|spec)[ ]*[#:]?[ ]*[-.a-z0-9_]+\b", r"\b[0-9]{3,}[-_][0-9]{2,}\b")} THEN 'identifier_code' ELSE 'generic_text' END"""
THRESHOLD = 80.0 + 13.0 * STRICTNESS
DIFFERENCE = f"""{FIELDS}, pairs AS (SELECT s.pair_id, s.ord AS i, t.ord AS j, s.nv AS a, t.nv AS b FROM s JOIN t USING (pair_id)), {common("SELECT a, b FROM pairs")},
e AS (SELECT pair_id, i, j, r, 1::BIGINT << i::INTEGER AS si, 1::BIGINT << (j % 100 + CASE WHEN j >= 100 THEN 10 ELSE 0 END)::INTEGER AS tj, row_number() OVER (PARTITION BY pair_id ORDER BY r DESC, i, j) AS n
  FROM pairs JOIN rt USING (a, b) WHERE r >= {50.0 + 22.0 * STRICTNESS!r}::DOUBLE),
walk AS (SELECT DISTINCT pair_id, 0::BIGINT AS n, 0::BIGINT AS us, 0::BIGINT AS ut, false AS taken, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS r FROM e
  UNION ALL SELECT w.pair_id, e.n, CASE WHEN us & si = 0 AND ut & tj = 0 THEN us | si ELSE us END, CASE WHEN us & si = 0 AND ut & tj = 0 THEN ut | tj ELSE ut END, us & si = 0 AND ut & tj = 0, e.i, e.j, e.r
  FROM walk w JOIN e ON e.pair_id = w.pair_id AND e.n = w.n + 1),
link AS (SELECT pair_id, i, j, r FROM walk WHERE taken),
diff0 AS (SELECT link.pair_id, CASE WHEN r >= {THRESHOLD!r}::DOUBLE THEN 'matched' ELSE 'changed' END AS kind, i AS s_ord, j AS t_ord, r AS score, s.value AS sv, t.value AS tv FROM link JOIN s ON s.pair_id = link.pair_id AND s.ord = i JOIN t ON t.pair_id = link.pair_id AND t.ord = j
  UNION ALL SELECT pair_id, 'missing', ord, NULL, NULL, value, NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.pair_id = s.pair_id AND link.i = s.ord)
  UNION ALL SELECT pair_id, 'extra', NULL, ord, NULL, NULL, value FROM t WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.pair_id = t.pair_id AND link.j = t.ord)),
diff1 AS (SELECT *, {CATEGORY} AS category FROM (SELECT *, trim(concat_ws(' ', sv, tv)) AS blob FROM diff0)),
diff2 AS (SELECT *, CASE category WHEN 'dimension' THEN 78 WHEN 'date' THEN 82 WHEN 'revision_status' THEN 70 WHEN 'identifier_code' THEN 66 ELSE 36 END
  + CASE WHEN regexp_extract_all(coalesce(sv, ''), '[0-9]+') <> regexp_extract_all(coalesce(tv, ''), '[0-9]+') THEN 14 ELSE 0 END
  + coalesce(floor(least(18e0, greatest(0e0, {THRESHOLD!r}::DOUBLE - score) * 0.65e0)), 0)::BIGINT AS raised FROM diff1),
diff3 AS (SELECT *, least(100, CASE WHEN length(coalesce(sv, '')) <= 2 OR length(coalesce(tv, '')) <= 2 THEN greatest(raised - 8, 0) ELSE raised END) AS own FROM diff2),
diff AS (SELECT *, CASE WHEN kind IN ('missing', 'extra') AND category IN ('dimension', 'date', 'revision_status') THEN least(100, own + 6) ELSE own END::BIGINT AS risk FROM diff3)"""
_PLACES = "list_position(['dimension', 'date', 'revision_status', 'identifier_code', 'generic_text'], category)"
_SNIPPET = "CASE WHEN length({0}) <= 72 THEN {0} ELSE rtrim({0}[1:71]) || '...' END"

SQL: dict[str, str] = {
    "sheet_ratios": RATIOS,
    "sheet_breakdown": f"WITH {SIGNALS} SELECT pair_id, i AS s_ord, j AS t_ord, {S4.format('ls')} AS label_similarity, {S4.format('vs')} AS value_similarity, {S4.format('tov')} AS token_overlap, {S4.format('rc')} AS regex_compatibility, {S4.format('total')} AS composite FROM cand",
    "sheet_assignment": f"WITH RECURSIVE {LINKS} SELECT pair_id, i AS s_ord, j AS t_ord FROM link",
    "sheet_results": f"WITH RECURSIVE {RESULTS} SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN s_ord IS NULL THEN 2 WHEN t_ord IS NULL THEN 1 ELSE 0 END, s_ord, t_ord) - 1 AS result_ord, s_ord, t_ord, kind AS match_type, {S4.format('conf')} AS confidence FROM results",
    "sheet_reasons": f"WITH RECURSIVE {RESULTS} SELECT pair_id, s_ord, t_ord, reason FROM results",
    "sheet_flag_reasons": f"""WITH RECURSIVE {FLAGS}, told AS (SELECT *, format('match_confidence={{:.3f}}', conf) AS at_, format('value_similarity={{:.3f}}; label_certainty={{:.3f}}', v, l) AS both_,
  format('field_type={{}}; critical_field={{}}; match_confidence=1.000', CASE WHEN coalesce(s_ord, t_ord) = 0 THEN 'title_block' ELSE 'ocr_region' END, CASE WHEN coalesce(s_ord, t_ord) = 0 THEN 'True' ELSE 'False' END) AS alone_ FROM g)
SELECT pair_id, reference AS field_reference, CASE kind WHEN 'missing_in_target' THEN 'missing_information' WHEN 'extra_in_target' THEN 'extra_information' WHEN 'changed_value' THEN 'changed_value' ELSE 'ambiguous_match' END AS type,
  CASE kind WHEN 'missing_in_target' THEN '[rule:missing_information] Source field absent on target drawing; ' || alone_ WHEN 'extra_in_target' THEN '[rule:extra_information] Target field has no aligned source counterpart; ' || alone_
    WHEN 'changed_value' THEN '[rule:changed_value] Value differs between source and target under aligned labels; ' || both_ || '; ' || at_ || '; engine=' || reason
    WHEN 'uncertain' THEN '[rule:ambiguous_match] match_type=uncertain; ' || at_ || '; ' || both_ || '; engine=' || reason
    ELSE '[rule:partial_match_review] Partial textual match; confirm semantic equivalence; ' || both_ || '; ' || at_ || '; engine=' || reason END AS reason FROM told WHERE kind <> 'exact_match'
UNION ALL SELECT pair_id, reference, 'possible_error', '[rule:possible_error_low_confidence] Low match confidence; possible OCR noise or wrong alignment; match_type=' || kind || '; ' || at_ || '; ' || both_ FROM told WHERE kind NOT IN ('missing_in_target', 'extra_in_target') AND conf < 0.55""",
    "sheet_report": f"""WITH RECURSIVE {FLAGS}, n AS (SELECT pair_id, count(*) FILTER (WHERE kind IN ('exact_match', 'partial_match')) AS matched, count(*) FILTER (WHERE kind = 'changed_value') AS changed, count(*) FILTER (WHERE kind = 'partial_match') AS partial,
  count(*) FILTER (WHERE kind = 'missing_in_target') AS missing, count(*) FILTER (WHERE kind = 'extra_in_target') AS extra, count(*) FILTER (WHERE kind = 'uncertain') AS uncertain, 's:' || pair_id || ':' || min(s_ord) FILTER (WHERE kind = 'missing_in_target') AS first_missing FROM results GROUP BY pair_id),
c AS (SELECT pair_id, count(*) AS flags FROM flag GROUP BY 1) SELECT pair_id, '1.0' AS version, matched, changed, partial, missing, extra, uncertain, coalesce(flags, 0) AS flags, first_missing FROM n LEFT JOIN c USING (pair_id)""",
    "sheet_flags": f"WITH RECURSIVE {FLAGS} SELECT pair_id, reference AS field_reference, type, severity, {S4.format('conf')} AS confidence FROM flag",
    "sheet_summary": f"""WITH RECURSIVE {RESULTS} SELECT pair_id, count(*) FILTER (WHERE kind <> 'extra_in_target') AS total_source, count(*) FILTER (WHERE kind IN ('exact_match', 'partial_match')) AS matched, count(*) FILTER (WHERE kind = 'changed_value') AS changed,
  count(*) FILTER (WHERE kind = 'missing_in_target') AS missing, count(*) FILTER (WHERE kind = 'extra_in_target') AS extra, count(*) FILTER (WHERE kind = 'uncertain') AS uncertain FROM results GROUP BY pair_id""",
    "sheet_legacy": f"WITH RECURSIVE {LEGACY}",
    "sheet_differences": f"WITH RECURSIVE {DIFFERENCE} SELECT pair_id, kind, s_ord, t_ord, {S4.format('score / 100')} AS score, category, risk FROM diff",
    "sheet_difference_summary": f"""WITH RECURSIVE {DIFFERENCE} SELECT pair_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ('matched', 'changed', 'missing', 'extra'))},
  {', '.join(f"count(*) FILTER (WHERE kind = 'changed' AND category = '{c}') AS changed_{c}" for c in ('dimension', 'date', 'revision_status', 'identifier_code', 'generic_text'))}, count(*) FILTER (WHERE kind <> 'matched' AND risk >= 72) AS high_risk FROM diff GROUP BY pair_id""",
    "sheet_recap": f"""WITH RECURSIVE {DIFFERENCE} SELECT pair_id, n AS rank, kind, category, risk, {_SNIPPET.format('sv')} AS source_snippet, {_SNIPPET.format('tv')} AS target_snippet FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY risk DESC, {_PLACES}, coalesce(score, 0) DESC, list_position(['changed', 'missing', 'extra'], kind), coalesce(s_ord, t_ord), t_ord) AS n FROM diff WHERE kind <> 'matched') WHERE n <= 8""",
}

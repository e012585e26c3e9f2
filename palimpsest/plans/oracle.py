"""The same queries as DuckDB SQL. Word bounds are spelled out, since its patterns know them for ASCII only.

Tables of patterns come from the library here; sheets.py and reports.py state theirs on their own.
"""

from __future__ import annotations

from palimpsest.functions.lines import BASE_RISK, CATEGORIES, MEANINGFUL
from palimpsest.functions.similarity import VALUE_PATTERNS
from palimpsest.operators.extract import RULES

_W = r"\p{L}\p{N}_"


def pattern(java: str) -> str:
    """A pattern of the library, rewritten for an existence test with RE2."""
    s = java.replace("(?iU)", "").replace("(?U)", "")
    s = s.replace(r"\bel\.\b.*\d", rf"\bel\.(?:\d|[{_W}].*\d)").replace(r"\bissue\s*#\b", rf"\bissue\s*#[{_W}]")
    s = s.replace(r"\b.*\d", rf"[^{_W}].*\d").replace(r"[\w.\-]", rf"[{_W}.\-]")
    out, i = "", 0
    while (j := s.find(r"\b", i)) >= 0:
        before = out + s[i:j]
        opens = before == "" or before[-1] in "|(" or before.endswith("(?:")
        out = before + (rf"(?:^|[^{_W}])" if opens else rf"(?:$|[^{_W}])")
        i = j + 2
    return out + s[i:]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def finds(column: str, *patterns: str, flags: str = "is") -> str:
    return f"regexp_matches({column}, {quoted('|'.join(map(pattern, patterns)))}, '{flags}')"


def count(column: str, p: str) -> str:
    return f"len(regexp_extract_all({column}, {quoted(p)}))"


LINES = r"""lines AS (
  SELECT doc_id AS pair_id, (i - 1)::BIGINT AS ord, ((i - 1) // 10 + 1)::INTEGER AS page, l[i] AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
  WHERE regexp_replace(l[i], '^[\s\x0b]+|[\s\x0b]+$', '', 'g') <> ''
)"""
STRIP = r"regexp_replace({0}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
NORM = r"trim(regexp_replace(lower({0}), '[\s\x0b]+', ' ', 'g'))"
SAME = f"""{LINES}, same AS (
  SELECT pair_id, ord, text, CASE k WHEN 1 THEN text || ' REV B' WHEN 2 THEN replace(text, 'e', '3') ELSE text END AS t_text
  FROM (SELECT *, (pair_id * 31 + ord * 17) % 10 AS k FROM lines) WHERE k <> 0
)"""

MEANS = f"(regexp_matches(t, {quoted('^(?:' + '|'.join(MEANINGFUL) + ')$')}, 'is') OR (length(t) <= 4 AND regexp_matches(t, '[a-z0-9]', 'i')))"
SYMBOLS = f"(CASE WHEN t = '' THEN 1.0 ELSE {count('t', chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's' + chr(34) + chr(39) + '°.–—/' + chr(92) * 2 + chr(92) + '-]')} / length(t) END)"
PUA = count("t", r"[\x{E000}-\x{F8FF}]")
ALNUM = count("t", r"[\p{L}\p{N}]")
COMPACT = "replace(t, ' ', '')"
MOST = f"(list_max(map_values(list_histogram(string_split({COMPACT}, '')))))"
MOST = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split({COMPACT}, '')) AS c) GROUP BY c))"
S = 0.92
NOISE = f"""CASE WHEN t = '' THEN true WHEN {MEANS} THEN false WHEN contains(t, chr(65533)) THEN true
  WHEN length(t) >= 3 AND {PUA} / length(t) >= {0.2 + 0.5 * S!r} THEN true
  WHEN length(t) >= 5 AND {ALNUM} / length(t) < {0.12 + 0.48 * S!r} THEN true
  WHEN length(t) >= 4 AND {SYMBOLS} > {0.55 + 0.35 * S!r} THEN true
  WHEN length({COMPACT}) >= 6 AND list_max(map_values(histo)) / length({COMPACT}) >= {0.88 - 0.08 * S!r} THEN true ELSE false END"""
JUDGED = f"""{LINES}, judged AS (
  SELECT pair_id, ord, page, {NOISE} AS noise, {NORM.format('text')} AS normalized
  FROM (SELECT *, list_histogram(string_split({COMPACT}, '')) AS histo FROM (SELECT *, {STRIP.format('text')} AS t FROM lines))
)"""
LIKELY = f"""{LINES}
SELECT pair_id, ord, (CASE WHEN t = '' THEN 0 ELSE least(100,
    (CASE WHEN contains(t, chr(65533)) THEN 45 ELSE 0 END)
  + (CASE WHEN length(t) >= 2 THEN floor(least(40.0, {PUA} / length(t) * 120)) ELSE 0 END)
  + (CASE WHEN length(t) >= 4 AND {ALNUM} / length(t) < 0.35 THEN 28 ELSE 0 END)
  + (CASE WHEN length(t) >= 3 AND {SYMBOLS} > 0.45 THEN 22 ELSE 0 END)
  + (CASE WHEN length(c) >= 5 AND len(list_distinct(string_split(c, ''))) <= 2 THEN 25 ELSE 0 END)
  + (CASE WHEN regexp_full_match(t, '[^\\p{{L}}\\p{{N}}]+') THEN 50 ELSE 0 END)) END)::INTEGER AS likelihood
FROM (SELECT *, regexp_replace(t, '[\\s\\x0b]+', '', 'g') AS c FROM (SELECT *, {STRIP.format('text')} AS t FROM lines))"""

BLOB = STRIP.format("(text || ' ' || t_text)")
CATEGORY = "CASE " + " ".join(f"WHEN {finds('blob', *p)} THEN '{name}'" for name, p in CATEGORIES.items()) + " ELSE 'generic_text' END"
CATEGORIZED = f"{SAME}, categorized AS (SELECT *, {CATEGORY} AS category FROM (SELECT *, {BLOB} AS blob FROM same))"
RISK = f"""CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in BASE_RISK.items())} END
  + CASE WHEN regexp_extract_all(text, '\\d+') <> regexp_extract_all(t_text, '\\d+') THEN 14 ELSE 0 END
  + floor(least(18.0, greatest(0.0, 80.0 + 13.0 * {S} - (ord * 13) % 100) * 0.65))"""

KIND = lambda c: "CASE " + " ".join(f"WHEN {finds(c, p, flags='i' if 'iU' in p else 'c')} THEN '{k}'" for k, p in VALUE_PATTERNS) + " END"

ITEMS = """a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem),
k AS (SELECT *, (l_orderkey * 31 + l_linenumber * 17) % 10 AS k FROM a),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN k = 1 THEN q + 1 ELSE q END AS q FROM k WHERE k <> 0
      UNION ALL SELECT l_orderkey, l_linenumber + 1000, q FROM k WHERE k = 3)"""

BOXES = """boxes AS (SELECT label AS page, vec_id AS id, embedding[1]::DOUBLE * 100 + 500 AS x1, embedding[2]::DOUBLE * 100 + 500 AS y1 FROM embeddings),
b AS (SELECT *, x1 + 8.0 AS x2, y1 + 4.0 AS y2 FROM boxes),
near AS (SELECT p.page, p.id AS a, q.id AS b, p.x1 - q.x1 AS dx, p.y1 - q.y1 AS dy,
  greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0.0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0.0) AS shared,
  (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS areas
  FROM b p JOIN b q ON p.page = q.page AND p.id < q.id)"""
DISTANCE = "sqrt((((p.x1+p.x2)/2) - ((q.x1+q.x2)/2))**2 + (((p.y1+p.y2)/2) - ((q.y1+q.y2)/2))**2)"


def _clusters(edge: str) -> str:
    return f"""WITH RECURSIVE {BOXES}, e AS (SELECT a AS u, b AS v FROM near WHERE {edge} UNION ALL SELECT b, a FROM near WHERE {edge}),
r AS (SELECT id, id AS c FROM boxes UNION SELECT e.v, r.c FROM r JOIN e ON r.id = e.u WHERE r.c < e.v)
SELECT id, min(c) AS cluster FROM r GROUP BY id"""


GOLD = """gold AS (
  SELECT *, match_type IS NOT NULL AND match_type <> 'extra_in_target' AS s, match_type IS NOT NULL AND match_type <> 'missing_in_target' AS t FROM (
  SELECT doc_id // 20 AS pair_id, doc_id AS field_id, n_chars AS n,
    CASE WHEN toxic = 1 THEN 'changed' WHEN quality = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'extra' ELSE 'matched' END AS expected,
    CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars % 7 = 0 THEN 'uncertain' WHEN n_chars < 200 THEN 'missing_in_target' WHEN n_chars % 5 = 0 THEN 'changed_value'
         WHEN n_chars % 13 = 0 THEN 'extra_in_target' WHEN n_chars % 3 = 0 THEN 'partial_match' ELSE 'exact_match' END AS match_type
  FROM labels JOIN documents USING (doc_id))
), judged AS (
  SELECT *, CASE WHEN match_type IN ('exact_match', 'partial_match') THEN 'matched' WHEN match_type = 'changed_value' THEN 'changed'
    WHEN match_type = 'missing_in_target' THEN 'missing' WHEN match_type = 'extra_in_target' THEN 'extra' END AS guess,
    s OR n % 2 = 0 AS in_source, t OR n % 4 = 0 AS in_target,
    CASE WHEN s THEN (n % 97) / 97 END AS s_conf, CASE WHEN t THEN (n % 89) / 89 END AS t_conf
  FROM gold
)"""
FAILURES = f"""{GOLD}, failed AS (
  SELECT *, match_type IN ('exact_match', 'partial_match', 'changed_value') AS paired FROM judged WHERE guess IS NULL OR guess <> expected
), named AS (
  SELECT pair_id, field_id,
    CASE WHEN match_type IS NULL THEN 'extraction' WHEN match_type = 'uncertain' THEN 'matching'
      WHEN expected IN ('missing', 'extra') AND paired THEN 'matching'
      WHEN expected IN ('matched', 'changed') AND match_type = 'missing_in_target' THEN 'matching'
      WHEN s AND t AND least(s_conf, t_conf) < 0.55 THEN 'ocr' ELSE 'classification' END AS category,
    CASE WHEN match_type IS NULL AND expected = 'extra' THEN CASE WHEN NOT in_target THEN 'gold_extra_field_not_in_target_extraction' ELSE 'gold_extra_field_in_target_but_no_result_row' END
      WHEN match_type IS NULL THEN CASE WHEN NOT in_source THEN 'gold_field_not_in_source_extraction' ELSE 'gold_field_extracted_but_no_match_row' END
      WHEN match_type = 'uncertain' THEN 'gold_' || expected || '_pred_uncertain'
      WHEN expected IN ('missing', 'extra') AND paired THEN 'gold_' || expected || '_pred_paired'
      WHEN expected IN ('matched', 'changed') AND match_type = 'missing_in_target' THEN 'gold_' || expected || '_pred_missing_in_target'
      WHEN s AND t AND least(s_conf, t_conf) < 0.55 THEN 'gold_' || expected || '_pred_' || match_type || '_low_field_confidence'
      ELSE 'gold_' || expected || '_pred_' || match_type END AS failure_pattern
  FROM failed
)"""
COUNTS = f"""{GOLD}, c AS (
  SELECT expected AS label, coalesce(guess = expected, false)::INT AS tp, 0 AS fp, (NOT coalesce(guess = expected, false))::INT AS fn FROM judged
  UNION ALL SELECT guess, 0, 1, 0 FROM judged WHERE guess IS NOT NULL AND guess <> expected
  UNION ALL SELECT unnest(['matched', 'changed', 'missing', 'extra']), 0, 0, 0
), n AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY label),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM n)"""
_SCALED = lambda x: f"floor(({x}) * 10000 + 0.5)::BIGINT"


def _rule(number: int) -> str:
    r = RULES[number]
    p = quoted(r.pattern)
    pick = lambda g: STRIP.format(f"regexp_extract(text, {p}, {g}, 'is')")
    label = quoted(r.fixed_label) if r.fixed_label is not None else pick(r.label)
    return f"SELECT pair_id, ord, '{r.rule_id}' AS rule_id, {label} AS label, {pick(r.value)} AS value FROM lines WHERE regexp_matches(text, {p}, 'is')"


SQL: dict[str, str] = {
    "norm_ocr_text": f"WITH {LINES} SELECT pair_id, ord, {NORM.format('text')} AS normalized FROM lines",
    "noise_filter": f"WITH {JUDGED} SELECT pair_id, ord, noise FROM judged",
    "noise_likelihood": f"WITH {LIKELY}",
    "line_scan_stats": f"""WITH {JUDGED}, d AS (SELECT *, row_number() OVER (PARTITION BY pair_id, page, noise, normalized ORDER BY ord) AS n FROM judged)
SELECT pair_id, page, count(*) AS raw, count(*) FILTER (WHERE noise) AS noise_dropped, count(*) FILTER (WHERE NOT noise AND n > 1) AS dedupe_removed, count(*) FILTER (WHERE NOT noise AND n = 1) AS kept FROM d GROUP BY pair_id, page""",
    "dedupe_keep_first": f"WITH {LINES} SELECT pair_id, page, min(ord) AS ord FROM lines GROUP BY pair_id, page, {NORM.format('text')}",
    "change_category": f"WITH {CATEGORIZED} SELECT pair_id, ord, category FROM categorized",
    "change_risk": f"""WITH {CATEGORIZED}, r AS (SELECT *, {RISK} AS r FROM categorized)
SELECT pair_id, ord, least(100, CASE WHEN length({STRIP.format('text')}) <= 2 OR length({STRIP.format('t_text')}) <= 2 THEN greatest(r - 8, 0) ELSE r END)::INTEGER AS risk FROM r""",
    "token_jaccard": f"""WITH {SAME}, s AS (SELECT pair_id, ord, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(t_text), '[a-z0-9]+')) AS b FROM same)
SELECT pair_id, ord, {_SCALED("CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END")} AS jaccard FROM s""",
    "value_pattern_kind": f"WITH {LINES} SELECT pair_id, ord, {KIND('text')} AS kind FROM lines",
    "regex_compat": f"""WITH {SAME}, s AS (SELECT pair_id, ord, {KIND('text')} AS a, {KIND('t_text')} AS b FROM same)
SELECT pair_id, ord, {_SCALED("CASE WHEN a IS NULL AND b IS NULL THEN 0.75 WHEN a IS NULL OR b IS NULL THEN 0.5 WHEN a = b THEN 1.0 ELSE 0.35 END")} AS compatibility FROM s""",
    "exact_revision_diff": f"""WITH {ITEMS}
SELECT CASE WHEN b.l_orderkey IS NULL THEN 'missing_in_target' WHEN a.l_orderkey IS NULL THEN 'extra_in_target' WHEN a.q IS NOT DISTINCT FROM b.q THEN 'exact_match' ELSE 'changed_value' END AS match_type,
  count(*) AS n, sum(coalesce(a.l_orderkey, b.l_orderkey))::BIGINT AS keys
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1""",
    "missing_rows": f"WITH {ITEMS} SELECT l_orderkey, l_linenumber FROM a ANTI JOIN b USING (l_orderkey, l_linenumber)",
    "extra_rows": f"WITH {ITEMS} SELECT l_orderkey, l_linenumber FROM b ANTI JOIN a USING (l_orderkey, l_linenumber)",
    "bbox_iou": f"WITH {BOXES} SELECT a, b, {_SCALED('shared / (areas - shared)')} AS iou FROM near WHERE abs(dx) < 8 AND abs(dy) < 4 AND shared > 0",
    "bbox_center_distance": f"WITH {BOXES} SELECT page, count(*) AS pairs, sum(a + b)::BIGINT AS ids FROM near WHERE sqrt(dx * dx + dy * dy) <= 3.0 GROUP BY page",
    "clusters_center_distance": _clusters("sqrt(dx * dx + dy * dy) <= 3.0"),
    "clusters_iou": _clusters("shared / (areas - shared) >= 0.2"),
    "tile_grid": """WITH p AS (SELECT o_orderkey, o_custkey % 5000 + 500 AS w, o_orderkey % 4000 + 400 AS h FROM orders),
x AS (SELECT o_orderkey, w, unnest(range(0, w, 1352)) AS x FROM p), y AS (SELECT o_orderkey, h, unnest(range(0, h, 1352)) AS y FROM p),
xs AS (SELECT * FROM x WHERE x = 0 OR x - 1352 + 1536 < w), ys AS (SELECT * FROM y WHERE y = 0 OR y - 1352 + 1536 < h)
SELECT o_orderkey, y // 1352 AS "row", x // 1352 AS "col", x, y, least(1536, w - x) AS width, least(1536, h - y) AS height FROM xs JOIN ys USING (o_orderkey)""",
    "token_box_offsets": r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
t AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i, list_sum(list_transform(w, lambda x: length(x))) AS total FROM w),
o AS (SELECT item_id, w[i] AS token, coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS before, total FROM t)
SELECT item_id, token, floor((0.0::DOUBLE + before * (1000.0::DOUBLE / total)) * 10000 + 0.5)::BIGINT AS x1, floor((0.0::DOUBLE + (before + length(token)) * (1000.0::DOUBLE / total)) * 10000 + 0.5)::BIGINT AS x2 FROM o""",
    "confusion_matrix": f"""WITH {GOLD}, l AS (SELECT unnest(['matched', 'changed', 'missing', 'extra']) AS expected),
b AS (SELECT expected, CASE WHEN match_type IS NULL THEN 'none' ELSE coalesce(guess, 'uncertain') END AS bucket FROM judged)
SELECT l.expected, {', '.join(f"count(*) FILTER (WHERE bucket = '{k}') AS {chr(34)}{k}{chr(34)}" for k in ('matched', 'changed', 'missing', 'extra', 'uncertain', 'none'))} FROM l LEFT JOIN b USING (expected) GROUP BY 1""",
    "prf1_by_label": f"WITH {COUNTS} SELECT label, tp, fp, fn, {_SCALED('p')} AS precision, {_SCALED('rc')} AS recall, {_SCALED('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END')} AS f1 FROM r",
    "binary_task": f"""WITH {GOLD}, t AS (
SELECT 'changed_value_detection' AS task, count(*) FILTER (WHERE guess = 'changed') AS correct, count(*) AS total FROM judged WHERE expected = 'changed'
UNION ALL SELECT 'missing_detection', count(*) FILTER (WHERE guess = 'missing'), count(*) FROM judged WHERE expected = 'missing')
SELECT task, correct, total, {_SCALED('correct / nullif(total, 0)')} AS accuracy FROM t""",
    "summary_rollup": f"WITH {GOLD} SELECT pair_id, count(*) AS fields, count(*) FILTER (WHERE guess = expected) AS correct FROM judged GROUP BY ROLLUP (pair_id)",
    "error_taxonomy": f"WITH {FAILURES} SELECT pair_id, field_id, category, failure_pattern FROM named",
    "top_patterns": f"WITH {FAILURES} SELECT failure_pattern, count(*) AS n, count(DISTINCT pair_id) AS pairs FROM named GROUP BY 1 ORDER BY n DESC, failure_pattern LIMIT 20",
    "first_k_examples": f"WITH {FAILURES} SELECT category, example::INTEGER AS example, field_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pair_id, field_id) AS example FROM named) WHERE example <= 8",
    "annotation_index": f"""WITH {GOLD} SELECT pair_id, field_id, n AS "index", format('ann-{{:03d}}', n) AS annotation_id FROM (
SELECT pair_id, field_id, row_number() OVER (PARTITION BY pair_id ORDER BY field_id) AS n FROM judged WHERE match_type IN ('changed_value', 'missing_in_target', 'extra_in_target', 'uncertain'))""",
    "extract_fields": f"WITH {LINES} " + " UNION ALL ".join(_rule(i) for i in range(len(RULES))),
    "validate_duplicates": """SELECT l_orderkey, l_suppkey, l_linenumber, occurrence FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS occurrence FROM lineitem) WHERE occurrence > 1""",
    "grounding_ints": r"""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '\d+(\.\d+)+|\.\d+', ' ', 'g'), '\d+'), lambda x: ltrim(x[1:-2], '0') || x[-1:])))::BIGINT AS integers FROM documents""",
    "stale_jobs": "SELECT event_id AS job_id, (floor(epoch(m)) - floor(epoch(ts)))::BIGINT AS age FROM events, (SELECT max(ts) AS m FROM events) WHERE floor(epoch(m)) - floor(epoch(ts)) > 86400",
}

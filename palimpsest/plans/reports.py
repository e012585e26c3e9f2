"""Queries of sources, fields, geometry, evaluation and reports, each with its SQL.

Where a query makes its input texts from columns of the given tables, the SQL states the expected
result from those columns directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import geometry, normalize
from palimpsest.functions import lines as L
from palimpsest.operators import batch, display, evaluate, extract, fields, pages, spatial, textdiff, validate
from palimpsest.plans import oracle, sheets, sinks
from palimpsest.sources import fixtures, recognition

table = fixtures.table


def _whole(c: Column, places: int = 4) -> Column:
    return F.floor(c * 10**places + 0.5).cast("long")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.lines(table(spark, sf, "documents"))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.gold(table(spark, sf, "labels"), table(spark, sf, "documents"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.boxes(table(spark, sf, "embeddings"))


# Sources.


def recognised_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Of three lines one comes as words, one with a box, and one with neither."""
    one = lambda w, i: F.struct(w.alias("text"), geometry.box(i * 10, F.lit(0), i * 10 + 8, F.lit(10)).alias("bbox"))
    words = F.when(F.col("ord") % 3 == 0, F.transform(F.split("text", r"(?U)\s"), one))
    bbox = F.when(F.col("ord") % 3 == 1, geometry.box(F.lit(0), F.lit(0), F.lit(500), F.lit(20)))
    rows = _lines(spark, sf).select(
        F.col("pair_id").alias("document_id"), F.col("page").alias("page_number"), (F.col("ord") % 10).alias("number"), "text", words.alias("words"), bbox.alias("bbox"), F.lit(1000.0).alias("width"), F.lit(800.0).alias("height")
    )
    made = recognition.result_lines(rows)
    return made.select("document_id", "line_id", F.size("tokens").cast("long").alias("tokens"), _whole(F.col("confidence")).alias("confidence"), _whole(F.col("bbox.x2"), 2).alias("x2"), _whole(F.col("bbox.y2"), 2).alias("y2"))


def hybrid_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three documents have embedded lines; all could be recognised."""
    rows = _lines(spark, sf).select(F.col("pair_id").alias("document_id"), "ord")
    embedded = rows.filter(F.col("document_id") % 3 != 0).withColumn("origin", F.lit("embedded"))
    both = recognition.embedded_first(embedded, rows.withColumn("origin", F.lit("recognised")))
    return both.groupBy("document_id", "origin").agg(F.count("*").alias("lines"))


def span_lines(spark: SparkSession, sf: str) -> DataFrame:
    span = lambda w, i: F.struct(w.alias("text"), geometry.box(i * 10, F.lit(0), i * 10 + 8, F.lit(10)).alias("bbox"))
    rows = _lines(spark, sf).select(
        F.col("pair_id").alias("document_id"), F.col("page").alias("page_number"), F.floor(F.col("ord") / 5).alias("block"), F.col("ord").alias("line"), F.transform(F.split("text", " "), span).alias("spans")
    )
    made = recognition.lines_from_spans(rows)
    return made.select("document_id", F.col("line").alias("ord"), "text", _whole(F.col("bbox.x2"), 0).alias("x2"))


def token_fields(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "benchmark").select(F.col("item_id").alias("document_id"), F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("ord", "text"))
    rows = tokens.withColumns({"page_number": F.lit(1), "normalized_text": normalize.ocr_text(F.col("text")), "bbox": geometry.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), "confidence": F.lit(0.5)})
    return fields.token_fields(rows).select("field_id", "field_type", "value", "normalized_value")


def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of word rows, among rows of other levels, blank words and confidences out of range."""
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"(?U)\s")).alias("n", "text"))
    rows = words.withColumns({"level": F.when(F.col("n") % 7 == 6, 4).otherwise(5), "conf": F.col("n") % 110 - 5, "line": F.floor(F.col("n") / 8), "bbox": geometry.box(F.col("n") * 10, F.col("n") % 3, F.col("n") * 10 + 9, F.lit(12))})
    made = recognition.lines_from_words(recognition.word_level(rows), ["item_id", "line"], "n")
    return made.select("item_id", "line", "text", _whole(F.col("confidence")).alias("confidence"), F.col("bbox.x1").cast("long").alias("x1"), F.col("bbox.x2").cast("long").alias("x2"))


def region_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the regions of document trees whose even pages have lines and odd ones only tokens."""
    none = F.lit(None)
    box = geometry.box(F.col("ord"), F.lit(0), F.col("ord") + 5, F.lit(5))
    unit = F.struct(F.col("text"), F.lit(0.5).alias("confidence"), box.alias("bbox"))
    page = _lines(spark, sf).groupBy("pair_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", unit.alias("u")))).alias("units"))
    whole = F.transform("units", lambda x: F.struct(none.cast("string").alias("id"), x["u"]["text"].alias("text"), x["u"]["confidence"].alias("confidence"), x["u"]["bbox"].alias("bbox")))
    part = F.transform("units", lambda x: F.struct(x["u"]["text"].alias("text"), x["u"]["confidence"].alias("confidence"), x["u"]["bbox"].alias("bbox")))
    even = F.col("page") % 2 == 0
    tree = F.struct(F.col("page").alias("page_number"), F.when(even, whole).otherwise(F.array()).alias("lines"), part.alias("tokens"))
    docs = page.groupBy(F.col("pair_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(tree)).alias("pages"))
    return recognition.region_fields(recognition.regions(docs)).select("field_id", F.col("page_number").cast("long").alias("page_number"), "value")


def page_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on odd pages, looked up by page."""
    rows = _lines(spark, sf).select(F.col("pair_id").alias("document_id"), F.col("page").alias("page_number"), "ord")
    odd = rows.select("document_id", "page_number").filter(F.col("page_number") % 2 == 1)
    return recognition.of_pages(rows, odd).groupBy("document_id").agg(F.count("*").alias("regions"))


# Texts.


def normalize_marks(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("pair_id", "ord", normalize.marks(normalize.folded(F.col("text"))).alias("normalized"))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of an order line with elevations, grouped thousands, decimal commas, drawing numbers, revisions and misread digits."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    us, eu = F.format_number(whole, 0), F.replace(F.format_number(whole, 0), F.lit(","), F.lit("."))
    key, n, q = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string")
    text = F.concat(
        F.lit("  Elev.: "), q, F.lit("  LENGTH "), us, F.lit("."), rest, F.lit(" or "), eu, F.lit(","), rest, F.lit(" \u2013 Rev # "), n, F.lit("\tDWG \u2014 "), F.lpad(key, 6, "0"), F.lit("  l"), q, F.lit("o "), q, F.lit("\u00d7"), n,
        F.lit(" \u201cq\u201d  "), n, F.lit("=1 R"), n, F.lit(" straße"),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))


def normalize_notes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return _notes(spark, sf).select("l_orderkey", "l_linenumber", normalize.normalize_value(text).alias("value"), normalize.normalize_line(text).alias("line"))


def normalize_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels between marks, and revisions alone."""
    label = F.when(F.col("p_partkey") % 4 == 0, "  R. EV. ").when(F.col("p_partkey") % 4 == 1, "Revision").otherwise(F.concat(F.lit(" \u2014 :"), "p_name", F.lit("  "), "p_brand", F.lit(" .; ")))
    rows = table(spark, sf, "part").select("p_partkey", normalize.normalize_label(label).alias("label"), "p_brand")
    return rows.select("p_partkey", "label", normalize.canonical_key(F.col("label"), F.concat("p_brand", F.lit("|x"))).alias("key"))


def field_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of sheets with gaps of four kinds, filled, and their keys."""
    k = (F.col("pair_id") + F.col("ord")) % 4
    none = F.lit("")
    rows = fixtures.sheets(table(spark, sf, "part")).select(
        "pair_id", "ord", F.when(k == 1, none).otherwise(F.col("label")).alias("label"), F.when(k == 1, none).when(k == 3, F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(k == 1, F.concat(F.lit("Raw "), "value")).alias("raw_text"), F.when(k == 2, F.lit("  given ")).alias("normalized_value"), F.lit(None).cast("string").alias("normalized_label"),
    )
    made = fields.backfilled(rows)
    return made.select("pair_id", "ord", "raw_text", "value", "normalized_label", "normalized_value", fields.comparison_key().alias("key"))


def line_previews(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("pair_id", "ord", L.preview(F.col("text")).alias("preview"), L.snippet(F.col("text")).alias("snippet"))


#: Lines that rules must read, with %: a value (fixed values).
LABELLED = ("Drawn By: %", "Project: %", "Date: %", "Scale: %", "Title: %", "DWG No.: %", "Sheet ID: %", "Key Plan: %", "REV. B%", "General Notes: %", "3. Long %", "Elev: +%.5", "%' - 6\"", "Material: x %")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    made = F.array(*[F.replace(F.lit(t), F.lit("%"), F.col("p_size").cast("string")) for t in LABELLED])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pair_id"), F.lit(0).alias("ord"), F.get(made, (F.col("p_partkey") % len(LABELLED)).cast("int")).alias("text"), F.lit(0.88).alias("confidence"))


def extract_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_matches(_labelled(spark, sf)).select("pair_id", "rule_id", "label", "value")


def extract_labelled_unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.extract_fields(_labelled(spark, sf), ["pair_id", "ord"])
    return rows.select("pair_id", "rule_id", "normalized_label", "normalized_value", _whole(F.col("field_confidence")).alias("confidence"))


def ungrounded_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and outcomes that a text claims but its report does not hold."""
    key = F.col("event_id")
    claim = F.concat(F.lit("In all "), (key % 5).cast("string"), F.lit(" of "), key.cast("string"), F.lit(" fields (3.5 %) are changed value, "), F.when(key % 2 == 0, "none missing_in_target").otherwise("the rest uncertain"))
    report = F.concat(F.lit("total 0"), key.cast("string"), F.lit(" changed_value 1; uncertain 2"))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(validate.ungrounded(claim, report)), ",").alias("ungrounded"))


# Geometry.


def box_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes scaled and shifted, as shares and pixels of a page, padded, and from corners."""
    b, w, h = F.col("bbox"), F.lit(1000.0), F.lit(800.0)
    moved = geometry.shifted(geometry.scaled(b, F.lit(0.5), F.lit(2.0)), F.lit(3.0), F.lit(-1.0))
    share = geometry.normalized(b, w, h)
    quad = geometry.from_quad(F.array(b["x2"], b["x1"], b["x1"], b["x2"]), F.array(b["y1"], b["y1"] - 1, b["y2"], b["y2"] + 1))
    size = geometry.from_xywh(b["x1"], b["y1"], F.lit(0.0), F.lit(7.0))
    pixels, padded = geometry.to_pixels(geometry.box(b["x1"] / w, b["y1"] / h, b["x2"] / w, b["y2"] / h), F.lit(512), F.lit(384)), geometry.padded(b, F.lit(2000.0), F.lit(1600.0))
    return _boxes(spark, sf).select(
        "id", _whole(moved["x1"], 2).alias("moved_x1"), _whole(moved["y2"], 2).alias("moved_y2"), _whole(share["x2"]).alias("share_x2"), _whole(share["y1"]).alias("share_y1"), pixels["x1"].alias("pixel_x1"),
        pixels["y2"].alias("pixel_y2"), _whole(padded["x1"], 2).alias("padded_x1"), _whole(quad["y1"], 2).alias("quad_y1"), _whole(quad["y2"], 2).alias("quad_y2"), _whole(size["x2"], 3).alias("size_x2"),
        _whole(geometry.confidence(b["x1"] % 150)).alias("confidence"),
    )


def region_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of a page of 1000 x 1000 on one of 1024 x 768, by an original of 2000 x 1500 that was turned."""
    size = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    made = geometry.remapped(F.col("bbox"), size(1000.0, 1000.0), size(2000, 1500), (F.col("id") % 7 - 3) * 1.5, size(1024.0, 768.0))
    return _boxes(spark, sf).select("id", *[_whole(made[c], 2).alias(c) for c in ("x1", "y1", "x2", "y2")])


def tile_regions(spark: SparkSession, sf: str) -> DataFrame:
    """One region a tile, merged into its page; pages too small for tiles are one."""
    w, h = (F.col("o_custkey") % 5000 + 500).cast("int"), (F.col("o_orderkey") % 4000 + 400).cast("int")
    one = F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("x"), F.lit(0).alias("y"), w.alias("width"), h.alias("height"))
    each = table(spark, sf, "orders").select("o_orderkey", F.explode(F.when(geometry.should_tile(w, h, 1536, 2048), geometry.tiles(w, h, 1536, 0.12)).otherwise(F.array(one))).alias("t"))
    merged = geometry.on_page(geometry.box(F.lit(10), F.lit(20), F.lit(50), F.lit(60)), F.col("t"))
    return each.select("o_orderkey", merged["x1"].cast("long").alias("x1"), merged["y2"].cast("long").alias("y2"))


def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages cut to a longest edge, and their badges."""
    w, h = (F.col("o_custkey") % 5000 + 500).cast("int"), (F.col("o_orderkey") % 4000 + 400).cast("int")
    small, badge = geometry.long_edge(w, h, 1536), geometry.badge(F.col("o_custkey"), w, h)
    return table(spark, sf, "orders").select("o_orderkey", small["width"].alias("width"), small["height"].alias("height"), badge["width"].alias("badge_width"), badge["height"].alias("badge_height"), badge["gap"].alias("gap"))


def line_directions(spark: SparkSession, sf: str) -> DataFrame:
    dx, dy = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    degrees = L.orientation(dx, dy)
    return table(spark, sf, "embeddings").select("vec_id", _whole(degrees, 2).alias("degrees"), L.is_vertical(degrees).alias("vertical"))


# Pages.


def page_pairs(spark: SparkSession, sf: str) -> DataFrame:
    source = _lines(spark, sf)
    target = fixtures.revised(source)
    side = lambda df: df.select("pair_id", F.col("page").alias("page_number")).distinct()
    return pages.aligned(side(source), side(target)).select("pair_id", F.col("slice").cast("long").alias("slice"), F.col("s_page").cast("long").alias("s_page"), F.col("t_page").cast("long").alias("t_page"))


def _pages_of_gold(spark: SparkSession, sf: str) -> DataFrame:
    rows = _gold(spark, sf).filter("match_type is not null")
    return rows.withColumns({"s_page_number": F.when(F.col("match_type") != "extra_in_target", F.col("field_id") % 3 + 1), "t_page_number": F.when(F.col("match_type") != "missing_in_target", F.col("field_id") % 4 + 1)})


def result_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Results on pages of comparisons that have three source and four target pages."""
    rows = _pages_of_gold(spark, sf)
    every = rows.select("pair_id").distinct()
    slices = pages.aligned(*[every.select("pair_id", F.explode(F.array(*[F.lit(i + 1).cast("long") for i in range(n)])).alias("page_number")) for n in (3, 4)])
    return pages.sliced(rows, slices).select("pair_id", "field_id", F.col("slice").cast("long").alias("slice"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("provider"), F.col("props").alias("text"), F.regexp_replace("props", r"\s", "").alias("normalized_text"), (F.col("event_id") % 97 / 97.0).alias("confidence"))


def provider_figures(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.provider_metrics(_tokens(spark, sf))
    return rows.select("provider", "tokens", "chars", "normalized_chars", _whole(F.col("mean_confidence")).alias("mean_confidence"), _whole(F.col("least_confidence")).alias("least_confidence"))


def provider_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking as the benchmark's report has it; a provider that failed is not in it."""
    failed = spark.range(1).select(F.lit("cloud").alias("provider"), F.lit("not_implemented").alias("error"))
    report = sinks.provider_benchmark(pages.provider_metrics(_tokens(spark, sf)), failed)
    return report.select(F.posexplode("ranking").alias("place", "provider")).select(F.col("place").cast("long").alias("place"), "provider")


def model_costs(spark: SparkSession, sf: str) -> DataFrame:
    cost = pages.model_cost(F.col("o_custkey"), F.col("o_orderkey"), F.lit(0.1234567), F.lit(0.7654321))
    return table(spark, sf, "orders").select("o_orderkey", _whole(cost, 6).alias("cost"))


# Evaluation.


def macro_scores(spark: SparkSession, sf: str) -> DataFrame:
    row = evaluate.run_summary(evaluate.counts(_gold(spark, sf)))
    return row.select("gold_fields", _whole(F.col("field_accuracy")).alias("field_accuracy"), _whole(F.col("macro_f1")).alias("macro_f1"))


def score_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of the table of scores, with six places."""
    rows = evaluate.precision_recall(evaluate.counts(_gold(spark, sf)))
    return rows.select("label", *[sinks.fixed(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def failure_categories(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.category_counts(evaluate.error_taxonomy(_gold(spark, sf)))


def failure_rationales(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.error_taxonomy(_gold(spark, sf)).select("pair_id", "field_id", "rationale")


def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the report, and how many failures its list holds."""
    row = sinks.error_analysis(evaluate.error_taxonomy(_gold(spark, sf)), 50)
    listed = F.json_array_length(F.get_json_object("report", "$.failures")).cast("long")
    return row.select("total_failures", "failures_omitted_count", listed.alias("listed"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two results a field; the later has another outcome."""
    rows = _gold(spark, sf).filter("match_type is not null").select("pair_id", F.col("field_id").alias("s_field_id"), F.col("field_id").alias("t_field_id"), "match_type", F.col("field_id").alias("result_ord"))
    return rows.unionByName(rows.withColumns({"result_ord": F.col("result_ord") + 1_000_000_000, "match_type": F.lit("uncertain"), "s_field_id": F.lit(None).cast("long")}))


def gold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    gold = _gold(spark, sf).select("pair_id", "field_id", "expected")
    return evaluate.joined(gold, _predictions(spark, sf)).select("pair_id", "field_id", "expected", "match_type")


def gold_membership(spark: SparkSession, sf: str) -> DataFrame:
    gold = _gold(spark, sf).select("pair_id", "field_id")
    rows = evaluate.with_membership(gold, gold.filter("field_id % 2 = 0"), gold.filter("field_id % 3 = 0").unionByName(gold.filter("field_id % 6 = 0")))
    return rows.select("pair_id", "field_id", "in_source", "in_target")


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    gold = _gold(spark, sf)
    pairs = gold.select("pair_id").distinct()
    errors = pairs.filter("pair_id % 11 = 0").withColumn("error", F.concat(F.lit("ValueError: pair "), F.col("pair_id").cast("string")))
    return batch.outcomes(pairs, pairs.filter("pair_id % 5 <> 0"), gold.filter("pair_id % 7 <> 0").select("pair_id", "field_id", "expected"), _predictions(spark, sf), errors)


def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf)


def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    return batch.run_totals(_batch(spark, sf))


def isolated_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A Python function that fails on some pairs: their errors are rows."""

    def one(group):
        if group.pair_id.iloc[0] % 11 == 0:
            raise ValueError(f"pair {group.pair_id.iloc[0]}")
        return group.groupby("expected", as_index=False).agg(n=("field_id", "count"))

    return batch.applied(_gold(spark, sf).select("pair_id", "field_id", "expected"), one, "expected string, n long")


# Reports.


def _sheet_results(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda side, k: (F.pmod(F.col(f"{side}_ord") * 37 + F.col("pair_id") * k, F.lit(101)) / 100.0)
    return sheets._results(spark, sf).withColumns({"s_confidence": share("s", 11), "t_confidence": share("t", 13), "s_raw_text": F.lit(""), "t_raw_text": F.lit("")})


def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = display.pair_rows(_sheet_results(spark, sf))
    title = display.titled(F.col("technical_match_type"), display.MATCH_TITLES)
    return rows.select("pair_id", "s_ord", "t_ord", "field_label", "on_source_drawing", "on_target_drawing", _whole(F.col("match_confidence")).alias("match_confidence"), "ocr_confidence", title.alias("title"))


def sheet_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.executive_sentence(sheets.sheet_summary(spark, sf))


def legend_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _gold(spark, sf).withColumns({"result_ord": F.col("field_id"), "s_bbox": F.lit(None).cast("double"), "t_bbox": F.lit(None).cast("double")})
    return display.legend_counts(spatial.annotations(rows)).select("pair_id", "match_type", "n", "title")


def annotation_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations on the source's box, or else the target's."""
    at = lambda x, side: F.when(F.col(side), geometry.box(F.col("field_id") + x, F.lit(0), F.col("field_id") + x + 5, F.lit(5)))
    rows = _gold(spark, sf).withColumns({"result_ord": -F.col("field_id"), "s_bbox": at(0, "in_source"), "t_bbox": at(0.5, "in_target")})
    return spatial.annotations(rows).select("pair_id", "field_id", F.col("index").cast("long").alias("index"), _whole(F.col("anchor.x1"), 1).alias("x1"))


def extras_without_reports(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    key = F.when(F.col("event_id") % 3 == 0, "comparison_json_report").when(F.col("event_id") % 3 == 1, "comparison_markdown_report").otherwise("note")
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(display.without_reports(F.create_map(key, F.col("event_type"), F.lit("type"), F.col("event_type"))))), ",").alias("keys"))


def sheet_top_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return textdiff.top_snippets(sheets._difference(spark, sf)).select("pair_id", "kind", F.col("rank").cast("long").alias("rank"), "s_ord", "t_ord")


def sheet_text_report(spark: SparkSession, sf: str) -> DataFrame:
    """The Markdown report of each sheet's differences, with tables of two rows."""
    return sinks.text_diff_markdown(sheets._difference(spark, sf), 2)


QUERIES = {
    f.__name__: f
    for f in (
        recognised_lines, hybrid_lines, span_lines, token_fields, word_lines, region_rows, page_regions, normalize_marks, normalize_notes, normalize_labels, field_backfill, line_previews, extract_labelled, extract_labelled_unique,
        box_measures, region_remap, tile_regions, page_sizes, line_directions, page_pairs, result_slices, provider_figures, provider_ranking, model_costs, macro_scores, score_cells, ungrounded_claims, failure_categories, failure_rationales,
        failure_report, gold_predictions, gold_membership, batch_outcomes, batch_totals, isolated_failures, pair_rows, sheet_sentences, legend_counts, annotation_anchors, extras_without_reports,
        sheet_top_snippets, sheet_text_report,
    )
}


def _w(c: str, places: int = 4) -> str:
    return f"floor(({c}) * {10**places} + 0.5)::BIGINT"


_WORDS = r"list_filter(regexp_split_to_array({0}, '[\s\x0b\x{{85}}\x{{a0}}]+'), lambda x: x <> '')"
_BOX = "b AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 + 500 AS x1, embedding[2]::DOUBLE * 100 + 500 AS y1, embedding[1]::DOUBLE * 100 + 500 + 8.0::DOUBLE AS x2, embedding[2]::DOUBLE * 100 + 500 + 4.0::DOUBLE AS y2 FROM embeddings)"
_GOLD = oracle.GOLD
_RATIONALE = {
    "gold_extra_field_in_target_but_no_result_row": "Target field was extracted but no EXTRA_IN_TARGET row references this id (check field_id consistency with the matcher output).",
    "gold_field_extracted_but_no_match_row": "Field exists on source extraction list but no MatchResult references this field_id.",
    "gold_missing_pred_paired": "Gold says the value is absent on B, but the matcher linked this source row to a target.",
    "gold_extra_pred_paired": "Gold says target-only extra, but this field was paired with a source row.",
    "gold_matched_pred_changed_value": "Matcher linked fields but classified values as changed while gold treats them as equivalent.",
    "gold_changed_pred_exact_match": "Matcher treated values as equivalent; gold expects a semantic change.",
    "gold_changed_pred_partial_match": "Matcher treated values as equivalent; gold expects a semantic change.",
}
_BATCH = f"""{_GOLD}, pairs AS (SELECT DISTINCT pair_id FROM judged), scored AS (SELECT pair_id, count(*) AS n, count(*) FILTER (WHERE guess = expected) AS c FROM judged WHERE pair_id % 7 <> 0 GROUP BY 1),
reasons AS (SELECT pair_id, n, c, CASE WHEN pair_id % 5 = 0 THEN 'Annotation file not found or not readable' WHEN n IS NULL THEN 'Annotation has no fields to score' WHEN pair_id % 11 = 0 THEN 'ValueError: pair ' || pair_id END AS why FROM pairs LEFT JOIN scored USING (pair_id)),
outcome AS (SELECT pair_id, why IS NULL AS success, why AS error_message, CASE WHEN why IS NULL THEN n END AS fields_total, CASE WHEN why IS NULL THEN c END AS fields_correct FROM reasons)"""
_CAPTION = "CASE WHEN trim({0}.label) <> '' AND trim({0}.value) <> '' THEN trim({0}.label) || ': ' || trim({0}.value) WHEN trim({0}.value) <> '' THEN trim({0}.value) WHEN trim({0}.label) <> '' THEN trim({0}.label) ELSE '(no text captured)' END"
_TITLES = "CASE {0} WHEN 'exact_match' THEN 'Exact match' WHEN 'partial_match' THEN 'Partial match' WHEN 'changed_value' THEN 'Changed text' WHEN 'missing_in_target' THEN 'Missing on target' WHEN 'extra_in_target' THEN 'Only on target' ELSE 'Unclear match' END"
#: For each template of a line: (rule, label, value with % for the part's size).
_EXPECTED = (
    (("tb_drawn_checked", "Drawn By", "%"), ("generic_kv", "Drawn By", "%")), (("tb_project_job", "Project", "%"), ("generic_kv", "Project", "%")), (("tb_date_sheet", "Date", "%"), ("generic_kv", "Date", "%")),
    (("tb_scale", "Scale", "%"), ("generic_kv", "Scale", "%")), (("tb_title", "Title", "%"), ("generic_kv", "Title", "%")), (("dwg_number", "DWG", "%"), ("generic_kv", "DWG No.", "%")),
    (("sheet_id", "Sheet", "%"), ("generic_kv", "Sheet ID", "%")), (("plan_id", "Key Plan", "%"), ("generic_kv", "Key Plan", "%")), (("revision_standalone", "REV", "B%"),),
    (("note_header", "General Notes", "%"), ("generic_kv", "General Notes", "%")), (("note_numbered", "3.", "Long %"),), (("elev_line", "Elev", "+%.5"), ("generic_kv", "Elev", "+%.5")), (("dim_imperial_run", "", "%' - 6\""),),
    (("generic_kv", "Material", "x %"),),
)
#: Confidence of a rule's fields on lines of confidence 0.88, in ten thousandths.
_WEIGHTS = {"tb_drawn_checked": 8272, "tb_project_job": 8184, "tb_date_sheet": 8184, "tb_scale": 8360, "tb_title": 8096, "dwg_number": 8272, "sheet_id": 8184, "plan_id": 7744, "revision_standalone": 8008, "note_header": 7920, "note_numbered": 7216, "elev_line": 7920, "dim_imperial_run": 7480, "generic_kv": 6336}


def _expected(unique: bool) -> str:
    """The rows of the table above; one-digit values are too short for the generic rule."""
    rows = []
    for k, found in enumerate(_EXPECTED):
        for n, (rule, label, value) in enumerate(found):
            shown = "replace(" + oracle.quoted(value) + ", '%', p_size::VARCHAR)"
            long = f" AND length({shown}) >= 2" if rule == "generic_kv" else ""
            if not unique:
                rows.append(f"SELECT p_partkey AS pair_id, {oracle.quoted(rule)} AS rule_id, {oracle.quoted(label)} AS label, {shown} AS value FROM part WHERE p_partkey % 14 = {k}{long}")
            elif n == 0 or label.lower() != found[0][1].lower():
                normal = {"DWG No.": "dwg no", "3.": "3"}.get(label, label.lower())
                low = f"lower({shown})"
                # A revision's letter and number stand alone, a run of feet and inches keeps its marks.
                rows.append(f"SELECT p_partkey AS pair_id, {oracle.quoted(rule)} AS rule_id, {oracle.quoted(normal)} AS normalized_label, {low} AS normalized_value, {_WEIGHTS[rule]} AS confidence FROM part WHERE p_partkey % 14 = {k}{long}")
    return " UNION ALL ".join(rows)


_MARKS = "replace(lower(text), 'ß', 'ss')"
for _pattern, _to in (
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{ad}\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}]", ""), (r"[\x{2018}\x{2019}\x{201a}\x{201b}\x{2b9}\x60]", "'"), (r"[\x{201c}-\x{201f}\x{ab}\x{bb}]", '"'),
    (r'([0-9/])"{2,}([\s=$]|$)', r'\1"\2'), (r'(^|[^0-9])"(\d/\d)', r"\1\2"), (r"[\x{2010}-\x{2015}\x{2212}]+", "-"), (r"(\d)\s*'\s*(\d)", r"\1' \2"), (r"(\d)''", r'\1"'),
    (r"(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)", r"\1 x \2"), (r"\s*=\s*", " = "), (r"\.{3,}|…", "..."), (r";{2,}", ";"), (r"[\s\x0b\x{a0}]+", " "),
):
    _MARKS = f"regexp_replace({_MARKS}, {oracle.quoted(_pattern)}, {oracle.quoted(_to)}, 'g')"
_PRICE = "(round(l_extendedprice * 100)::BIGINT // 100) || '.' || lpad((round(l_extendedprice * 100)::BIGINT % 100)::VARCHAR, 2, '0')"

SQL: dict[str, str] = {
    "recognised_lines": f"""WITH {oracle.LINES}, w AS (SELECT *, {_WORDS.format('text')} AS ws, regexp_split_to_array(text, '[\\s\\x0b\\x{{85}}\\x{{a0}}]') AS parts FROM lines)
SELECT pair_id AS document_id, 'p' || page || '-l' || (ord % 10) AS line_id, len(ws)::BIGINT AS tokens, CASE WHEN ord % 3 = 0 THEN 9500 ELSE 9000 END AS confidence,
  CASE ord % 3 WHEN 0 THEN ((list_max(list_filter(range(len(parts)), lambda i: parts[i + 1] <> '')) * 10 + 8) * 100)::BIGINT WHEN 1 THEN 50000 ELSE 100000 END AS x2, CASE ord % 3 WHEN 0 THEN 1000 WHEN 1 THEN 2000 ELSE 12000 END AS y2 FROM w""",
    "hybrid_lines": f"WITH {oracle.LINES} SELECT pair_id AS document_id, CASE WHEN pair_id % 3 <> 0 THEN 'embedded' ELSE 'recognised' END AS origin, count(*) AS lines FROM lines GROUP BY 1, 2",
    "span_lines": f"""WITH {oracle.LINES}, w AS (SELECT *, string_split(text, ' ') AS parts FROM lines)
SELECT pair_id AS document_id, ord, trim(array_to_string(list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> ''), ' ')) AS text, list_max(list_filter(range(len(parts)), lambda i: trim(parts[i + 1]) <> '')) * 10 + 8 AS x2 FROM w""",
    "token_fields": f"""WITH w AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark)
SELECT 'token:' || item_id || ':1:' || (i - 1) AS field_id, 'ocr_token' AS field_type, ws[i] AS value, lower(ws[i]) AS normalized_value FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)""",
    "word_lines": r"""WITH w AS (SELECT item_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS n FROM (SELECT item_id, regexp_split_to_array(text, '[\s\x0b]') AS p FROM benchmark)),
k AS (SELECT *, n // 8 AS line FROM w WHERE n % 7 <> 6 AND trim(text) <> '')
SELECT item_id, line, string_agg(text, ' ' ORDER BY n) AS text, floor(round(avg(CASE WHEN n % 110 < 5 THEN 0 ELSE least(1, (n % 110 - 5) / 100) END), 6) * 10000 + 0.5)::BIGINT AS confidence, min(n) * 10 AS x1, max(n) * 10 + 9 AS x2 FROM k GROUP BY 1, 2""",
    "region_rows": f"WITH {oracle.LINES} SELECT pair_id || ':' || page || ':' || (row_number() OVER (PARTITION BY pair_id, page ORDER BY ord) - 1) AS field_id, page::BIGINT AS page_number, text AS value FROM lines",
    "ungrounded_claims": """SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN (event_id % 5) NOT IN (event_id, 1, 2) THEN (event_id % 5)::VARCHAR END, CASE WHEN event_id % 2 = 0 THEN 'missing_in_target' END], lambda x: x IS NOT NULL)), ',') AS ungrounded FROM events""",
    "score_cells": f"WITH {oracle.COUNTS} SELECT label, format('{{:.6f}}', p::DOUBLE) AS precision, format('{{:.6f}}', rc::DOUBLE) AS recall, format('{{:.6f}}', CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END::DOUBLE) AS f1 FROM r",
    "page_regions": f"WITH {oracle.LINES} SELECT pair_id AS document_id, count(*) AS regions FROM lines WHERE page % 2 = 1 GROUP BY 1",
    "normalize_marks": f"WITH {oracle.LINES} SELECT pair_id, ord, trim({_MARKS}) AS normalized FROM lines",
    "normalize_notes": f"""SELECT l_orderkey, l_linenumber,
  'el ' || q || ' length ' || p || ' or ' || p || ' - rev ' || n || ' dwg-' || k || ' 1' || q || '0 ' || q || ' x ' || n || ' "q" ' || n || ' = 1 rev ' || n || ' strasse' AS value,
  'elev.: ' || q || ' length ' || p || ' or ' || p || ' - rev # ' || n || ' dwg-' || k || ' l' || q || 'o ' || q || ' x ' || n || ' "q" ' || n || ' = 1 r' || n || ' strasse' AS line
FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, {_PRICE} AS p, l_linenumber AS n, lpad(l_orderkey::VARCHAR, 6, '0') AS k FROM lineitem)""",
    "normalize_labels": """SELECT p_partkey, label, label || '|' || p_brand || '/x' AS key FROM (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'rev' WHEN 1 THEN 'rev' ELSE lower(p_name) || ' ' || lower(p_brand) END AS label FROM part)""",
    "field_backfill": f"""WITH {sheets.FIELDS}, f AS (SELECT pair_id, ord, (pair_id + ord) % 4 AS k, label AS l0, value AS v0 FROM s),
g AS (SELECT *, CASE WHEN k = 1 THEN '' ELSE l0 END AS label, CASE k WHEN 1 THEN 'Raw ' || v0 WHEN 3 THEN '' ELSE v0 END AS value0 FROM f),
h AS (SELECT *, CASE WHEN k = 1 THEN value0 WHEN label = '' AND value0 = '' THEN '' ELSE trim(trim(label || ': ' || value0), ':') END AS raw_text FROM g),
i AS (SELECT *, CASE WHEN value0 = '' AND label = '' THEN raw_text ELSE value0 END AS value FROM h),
j AS (SELECT *, lower(trim(label)) AS nl, CASE WHEN k = 2 THEN 'given' ELSE lower(trim(value)) END AS nv FROM i)
SELECT pair_id, ord, raw_text, value, nl AS normalized_label, nv AS normalized_value, CASE WHEN label <> '' AND value <> '' THEN nl || '|' || nv WHEN nv <> '' THEN nv WHEN nl <> '' THEN nl ELSE '' END AS key FROM j""",
    "line_previews": f"""WITH {oracle.LINES}, t AS (SELECT pair_id, ord, trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')) AS p, {oracle.STRIP.format('text')} AS s FROM lines)
SELECT pair_id, ord, CASE WHEN length(p) <= 80 THEN p ELSE p[1:77] || '...' END AS preview, CASE WHEN length(s) <= 72 THEN s ELSE rtrim(s[1:71]) || '...' END AS snippet FROM t""",
    "extract_labelled": _expected(False),
    "extract_labelled_unique": _expected(True),
    "box_measures": f"""WITH {_BOX} SELECT id, {_w('x1 * 0.5 + 3', 2)} AS moved_x1, {_w('y2 * 2 - 1', 2)} AS moved_y2, {_w('round(greatest(0, least(1, x2 / 1000)), 6)')} AS share_x2, {_w('round(greatest(0, least(1, y1 / 800)), 6)')} AS share_y1,
  floor(x1 / 1000 * 512)::BIGINT AS pixel_x1, ceil(y2 / 800 * 384)::BIGINT AS pixel_y2, {_w('greatest(0, x1 - 5)', 2)} AS padded_x1, {_w('y1 - 1', 2)} AS quad_y1, {_w('y2 + 1', 2)} AS quad_y2, {_w('x1 + 0.001', 3)} AS size_x2,
  {_w('greatest(0, least(1, CASE WHEN x1 % 150 > 1 THEN x1 % 150 / 100 ELSE x1 % 150 END))')} AS confidence FROM b""",
    "region_remap": f"""WITH {_BOX}, a AS (SELECT *, radians((id % 7 - 3) * 1.5::DOUBLE) AS r FROM b), n AS (SELECT *, round_even(1500 * abs(sin(r)) + 2000 * abs(cos(r)), 0) AS nw, round_even(1500 * abs(cos(r)) + 2000 * abs(sin(r)), 0) AS nh FROM a),
p AS (SELECT *, unnest([x1, x2, x2, x1]) * 2.0 AS px, unnest([y1, y1, y2, y2]) * 1.5 AS py FROM n), q AS (SELECT *, (cos(r) * (px - 1000) + sin(r) * (py - 750) + nw / 2) * 1024 / nw AS qx, (cos(r) * (py - 750) - sin(r) * (px - 1000) + nh / 2) * 768 / nh AS qy FROM p),
e AS (SELECT id, greatest(0, least(min(qx), 1024 - 0.001)) AS ax, greatest(0, least(min(qy), 768 - 0.001)) AS ay, max(qx) AS bx, max(qy) AS cy FROM q GROUP BY id)
SELECT id, {_w('ax', 2)} AS x1, {_w('ay', 2)} AS y1, {_w('greatest(ax + 0.001, least(bx, 1024))', 2)} AS x2, {_w('greatest(ay + 0.001, least(cy, 768))', 2)} AS y2 FROM e""",
    "tile_regions": """WITH p AS (SELECT o_orderkey, o_custkey % 5000 + 500 AS w, o_orderkey % 4000 + 400 AS h FROM orders), t AS (SELECT * FROM p WHERE greatest(w, h) > 1536 OR least(w, h) >= 2048),
x AS (SELECT o_orderkey, w, unnest(range(0, w, 1352)) AS x FROM t), y AS (SELECT o_orderkey, h, unnest(range(0, h, 1352)) AS y FROM t), xs AS (SELECT * FROM x WHERE x = 0 OR x - 1352 + 1536 < w), ys AS (SELECT * FROM y WHERE y = 0 OR y - 1352 + 1536 < h)
SELECT o_orderkey, x + 10 AS x1, y + 60 AS y2 FROM xs JOIN ys USING (o_orderkey) UNION ALL SELECT o_orderkey, 10, 60 FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)""",
    "page_sizes": """WITH p AS (SELECT o_orderkey, o_custkey, (o_custkey % 5000 + 500)::INTEGER AS w, (o_orderkey % 4000 + 400)::INTEGER AS h FROM orders),
f AS (SELECT *, greatest(w, h) AS m, least(28.0::DOUBLE, greatest(10.0::DOUBLE, greatest(w, h) / 70.0::DOUBLE)) AS raw FROM p), g AS (SELECT *, greatest(10, round_even(raw, 0)::INTEGER) AS font FROM f)
SELECT o_orderkey, CASE WHEN m > 1536 THEN greatest(1, round_even(w * (1536 / m::DOUBLE), 0)::INTEGER) ELSE w END AS width, CASE WHEN m > 1536 THEN greatest(1, round_even(h * (1536 / m::DOUBLE), 0)::INTEGER) ELSE h END AS height,
  (greatest(font, ceil(font * 0.7::DOUBLE * length(o_custkey::VARCHAR))::INTEGER) + 2 * greatest(6, round_even(font * 0.45::DOUBLE, 0)::INTEGER))::INTEGER AS badge_width, (font + 2 * greatest(4, round_even(font * 0.3::DOUBLE, 0)::INTEGER))::INTEGER AS badge_height, greatest(4, round_even(raw * 0.45::DOUBLE, 0)::INTEGER) AS gap FROM g""",
    "line_directions": f"""WITH d AS (SELECT vec_id, CASE WHEN embedding[1] = 0 AND embedding[2] = 0 THEN 0::DOUBLE ELSE degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)) END AS d FROM embeddings)
SELECT vec_id, {_w('d', 2)} AS degrees, least(abs(d - 90), abs(d + 90)) <= 15 AS vertical FROM d""",
    "page_pairs": f"""WITH {oracle.LINES}, a AS (SELECT DISTINCT pair_id, page FROM lines), b AS (SELECT DISTINCT pair_id, page FROM lines WHERE (pair_id * 31 + ord * 17) % 10 <> 0)
SELECT pair_id, page::BIGINT AS slice, a.page::BIGINT AS s_page, b.page::BIGINT AS t_page FROM a FULL JOIN b USING (pair_id, page)""",
    "result_slices": f"""WITH {_GOLD}, r AS (SELECT pair_id, field_id, match_type, field_id % 3 + 1 AS s, field_id % 4 + 1 AS t FROM judged WHERE match_type IS NOT NULL)
SELECT pair_id, field_id, CASE WHEN match_type = 'extra_in_target' THEN t ELSE s END AS slice FROM r WHERE match_type IN ('extra_in_target', 'missing_in_target') OR s = t""",
    "provider_figures": f"SELECT event_type AS provider, count(*) AS tokens, sum(length(props))::BIGINT AS chars, sum(length(regexp_replace(props, '\\s', '', 'g')))::BIGINT AS normalized_chars, {_w('avg(event_id % 97 / 97.0::DOUBLE)')} AS mean_confidence, {_w('min(event_id % 97 / 97.0::DOUBLE)')} AS least_confidence FROM events GROUP BY 1",
    "provider_ranking": "SELECT row_number() OVER (ORDER BY n DESC, c DESC, provider) - 1 AS place, provider FROM (SELECT event_type AS provider, sum(length(regexp_replace(props, '\\s', '', 'g'))) AS n, avg(event_id % 97 / 97.0::DOUBLE) AS c FROM events GROUP BY 1)",
    "model_costs": f"SELECT o_orderkey, {_w('round_even((o_custkey * 0.1234567::DOUBLE + o_orderkey * 0.7654321::DOUBLE) / 1000000, 6)', 6)} AS cost FROM orders",
    "macro_scores": f"WITH {oracle.COUNTS}, f AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f1 FROM r) SELECT sum(tp + fn)::BIGINT AS gold_fields, {_w('sum(tp)::DOUBLE / sum(tp + fn)')} AS field_accuracy, {_w('avg(f1) FILTER (WHERE tp + fn > 0)')} AS macro_f1 FROM f",
    "failure_categories": f"WITH {oracle.FAILURES} SELECT c.category, count(named.field_id) AS n, count(DISTINCT pair_id) AS pairs FROM (SELECT unnest(['ocr', 'extraction', 'matching', 'classification']) AS category) c LEFT JOIN named USING (category) GROUP BY 1",
    "failure_rationales": f"""WITH {oracle.FAILURES} SELECT pair_id, field_id, CASE {' '.join(f"WHEN failure_pattern = '{k}' THEN {oracle.quoted(v)}" for k, v in list(_RATIONALE.items())[:2])}
  WHEN category = 'extraction' THEN 'No MatchResult row for this field_id — it was not present in extracted fields under the same id, so parsing never produced an alignable row.'
  WHEN category = 'ocr' THEN 'At least one side of the pair has field confidence below 0.55 (noisy OCR / weak extraction signal).'
  WHEN failure_pattern LIKE '%\\_pred\\_uncertain' ESCAPE '\\' THEN 'Greedy alignment produced a pair but composite scores landed in the uncertain band.'
  {' '.join(f"WHEN failure_pattern = '{k}' THEN {oracle.quoted(v)}" for k, v in list(_RATIONALE.items())[2:])}
  WHEN category = 'matching' THEN 'Source field exists but no target candidate met min_pair_composite — alignment failure.'
  ELSE 'Outcome mismatch after alignment; thresholds or similarity features likely need tuning.' END AS rationale FROM named""",
    "failure_report": f"WITH {oracle.FAILURES} SELECT count(*) AS total_failures, greatest(count(*) - 50, 0) AS failures_omitted_count, least(count(*), 50) AS listed FROM named",
    "gold_predictions": f"WITH {_GOLD} SELECT pair_id, field_id, expected, match_type FROM judged",
    "gold_membership": f"WITH {_GOLD} SELECT pair_id, field_id, field_id % 2 = 0 AS in_source, field_id % 3 = 0 AS in_target FROM judged",
    "batch_outcomes": f"WITH {_BATCH} SELECT * FROM outcome",
    "batch_totals": f"WITH {_BATCH} SELECT count(*) AS pairs_attempted, count(*) FILTER (WHERE success) AS pairs_succeeded, count(*) FILTER (WHERE NOT success) AS pairs_failed, coalesce(sum(fields_total), 0)::BIGINT AS fields_total, coalesce(sum(fields_correct), 0)::BIGINT AS fields_correct FROM outcome",
    "isolated_failures": f"""WITH {_GOLD} SELECT pair_id, expected, count(*) AS n, NULL::VARCHAR AS error FROM judged WHERE pair_id % 11 <> 0 GROUP BY 1, 2
UNION ALL SELECT DISTINCT pair_id, NULL, NULL, 'ValueError: pair ' || pair_id FROM judged WHERE pair_id % 11 = 0""",
    "pair_rows": f"""WITH RECURSIVE {sheets.RESULTS} SELECT r.pair_id, r.s_ord, r.t_ord, coalesce(nullif(s.nl, ''), nullif(t.nl, '')) AS field_label, CASE WHEN s.ord IS NOT NULL THEN {_CAPTION.format('s')} END AS on_source_drawing,
  CASE WHEN t.ord IS NOT NULL THEN {_CAPTION.format('t')} END AS on_target_drawing, {_w('round_even(conf, 4)')} AS match_confidence,
  concat_ws(' / ', CASE WHEN s.ord IS NOT NULL THEN ((s_ord * 37 + r.pair_id * 11) % 101) || '%' END, CASE WHEN t.ord IS NOT NULL THEN ((t_ord * 37 + r.pair_id * 13) % 101) || '%' END) AS ocr_confidence, {_TITLES.format('kind')} AS title
FROM results r LEFT JOIN s ON s.pair_id = r.pair_id AND s.ord = r.s_ord LEFT JOIN t ON t.pair_id = r.pair_id AND t.ord = r.t_ord""",
    "sheet_sentences": f"""WITH RECURSIVE {sheets.RESULTS}, n AS (SELECT pair_id, count(*) FILTER (WHERE kind <> 'extra_in_target') AS total, count(*) FILTER (WHERE kind IN ('exact_match', 'partial_match')) AS a, count(*) FILTER (WHERE kind = 'changed_value') AS b,
  count(*) FILTER (WHERE kind = 'missing_in_target') AS c, count(*) FILTER (WHERE kind = 'extra_in_target') AS d, count(*) FILTER (WHERE kind = 'uncertain') AS e FROM results GROUP BY 1)
SELECT pair_id, total || ' source fields: ' || concat_ws('; ', CASE WHEN a > 0 THEN a || ' matched' END, CASE WHEN b > 0 THEN b || ' changed' END, CASE WHEN c > 0 THEN c || ' missing in the target' END, CASE WHEN d > 0 THEN d || ' only in the target' END, CASE WHEN e > 0 THEN e || ' uncertain' END) AS sentence FROM n""",
    "legend_counts": f"WITH {_GOLD} SELECT pair_id, match_type, count(*) AS n, {_TITLES.format('match_type')} AS title FROM judged WHERE match_type IN ('changed_value', 'missing_in_target', 'extra_in_target', 'uncertain') GROUP BY 1, 2",
    "annotation_anchors": f"""WITH {_GOLD} SELECT pair_id, field_id, row_number() OVER (PARTITION BY pair_id ORDER BY field_id DESC) AS "index", CASE WHEN in_source THEN field_id * 10 WHEN in_target THEN field_id * 10 + 5 END AS x1 FROM judged WHERE match_type IN ('changed_value', 'missing_in_target', 'extra_in_target', 'uncertain')""",
    "extras_without_reports": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'note,type' ELSE 'type' END AS keys FROM events",
    "sheet_top_snippets": f"""WITH RECURSIVE {sheets.DIFFERENCE} SELECT pair_id, kind, n AS rank, s_ord, t_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id, kind ORDER BY risk DESC, {sheets._PLACES}, coalesce(score, 0) DESC, coalesce(s_ord, t_ord), t_ord) AS n FROM diff WHERE kind <> 'matched') WHERE n <= CASE WHEN kind = 'changed' THEN 5 ELSE 3 END""",
    "sheet_text_report": f"""WITH RECURSIVE {sheets.DIFFERENCE}, n AS (SELECT pair_id, kind, row_number() OVER (PARTITION BY pair_id, kind ORDER BY coalesce(s_ord, t_ord), t_ord) AS n, '| ' || coalesce(sv, '') || ' | ' || coalesce(tv, '') || ' | ' || coalesce(format('{{:.1f}}', score), '-') || ' |' AS line FROM diff WHERE kind <> 'matched'),
k AS (SELECT pair_id, kind, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n <= 2) AS body, count(*) AS many FROM n GROUP BY 1, 2),
p AS (SELECT pair_id, string_agg(chr(10) || chr(10) || '## ' || upper(kind[1]) || kind[2:] || chr(10) || chr(10) || '| Source | Target | Score |' || chr(10) || '| --- | --- | --- |' || chr(10) || body || CASE WHEN many > 2 THEN chr(10) || '_… ' || (many - 2) || ' more_' ELSE '' END, '' ORDER BY list_position(['changed', 'missing', 'extra'], kind)) AS parts FROM k GROUP BY 1),
c AS (SELECT pair_id, count(*) FILTER (WHERE kind = 'matched') AS a, count(*) FILTER (WHERE kind = 'changed') AS b, count(*) FILTER (WHERE kind = 'missing') AS m, count(*) FILTER (WHERE kind = 'extra') AS e FROM diff GROUP BY 1)
SELECT pair_id, '# Text differences' || chr(10) || chr(10) || '| Kind | Count |' || chr(10) || '| --- | --- |' || chr(10) || '| matched | ' || a || ' |' || chr(10) || '| changed | ' || b || ' |' || chr(10) || '| missing | ' || m || ' |' || chr(10) || '| extra | ' || e || ' |' || coalesce(parts, '') AS markdown FROM c LEFT JOIN p USING (pair_id)""",
}

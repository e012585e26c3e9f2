"""Registered queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import CompareConfig, match_threshold
from palimpsest.functions import geometry, normalize, similarity
from palimpsest.functions import lines as L
from palimpsest.operators import classify, compare, evaluate, extract, matching, spatial, textdiff, validate
from palimpsest.plans import oracle, reports, sheets
from palimpsest.scratch import checkpointed
from palimpsest.sources import fixtures, recognition

Query = Callable[[SparkSession, str], DataFrame]
STRICTNESS = 0.92
SERVICE = CompareConfig.service()


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.lines(fixtures.table(spark, sf, "documents"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    source = _lines(spark, sf)
    return source, fixtures.revised(source)


def _fields(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    source, target = _sides(spark, sf)
    return fixtures.fields(source, "s"), fixtures.fields(target, "t")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.gold(fixtures.table(spark, sf, "labels"), fixtures.table(spark, sf, "documents"))


def _scaled(c, places: int = 4):
    """A float as a whole number of the last place, so that engines compare equal."""
    return F.floor(c * 10**places + 0.5).cast("long")


def norm_ocr_text(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("pair_id", "ord", normalize.ocr_text(F.col("text")).alias("normalized"))


def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("pair_id", "ord", L.noise_line(F.col("text"), STRICTNESS).alias("noise"))


def noise_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("pair_id", "ord", L.noise_likelihood(F.col("text")).alias("likelihood"))


def line_scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    return textdiff.page_stats(_lines(spark, sf), STRICTNESS).filter(F.col("page").isNotNull()).select("pair_id", "page", "raw", "noise_dropped", "dedupe_removed", "kept")


def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return textdiff.first_of_each(fixtures.with_normalized(_lines(spark, sf))).select("pair_id", "page", "ord")


def _same_place(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _sides(spark, sf)
    return source.join(target.select("pair_id", "ord", F.col("text").alias("t_text")), ["pair_id", "ord"])


def change_category(spark: SparkSession, sf: str) -> DataFrame:
    return _same_place(spark, sf).select("pair_id", "ord", L.change_category(F.col("text"), F.col("t_text")).alias("category"))


def change_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _same_place(spark, sf).withColumn("category", L.change_category(F.col("text"), F.col("t_text")))
    score = F.pmod(F.col("ord") * 13, F.lit(100)).cast("double")
    return rows.select("pair_id", "ord", L.change_risk(F.col("category"), F.col("text"), F.col("t_text"), score, match_threshold(STRICTNESS)).alias("risk"))


def token_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _same_place(spark, sf).select("pair_id", "ord", _scaled(similarity.jaccard(F.col("text"), F.col("t_text"))).alias("jaccard"))


def value_pattern_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("pair_id", "ord", similarity.value_kind(F.col("text")).alias("kind"))


def regex_compat(spark: SparkSession, sf: str) -> DataFrame:
    return _same_place(spark, sf).select("pair_id", "ord", _scaled(similarity.regex_compatibility(F.col("text"), F.col("t_text"))).alias("compatibility"))


def _revised_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    source = fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    k = F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17, F.lit(10))
    kept = source.filter(k != 0).withColumn("q", F.when(k == 1, F.col("q") + 1).otherwise(F.col("q")))
    new = source.filter(k == 3).withColumn("l_linenumber", F.col("l_linenumber") + 1000)
    return source, kept.unionByName(new)


def exact_revision_diff(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _revised_items(spark, sf)
    rows = compare.exact_revision_diff(source, target, ["l_orderkey", "l_linenumber"], F.col("q"))
    return rows.groupBy("match_type").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _revised_items(spark, sf)
    return source.join(target, ["l_orderkey", "l_linenumber"], "left_anti").select("l_orderkey", "l_linenumber")


def extra_rows(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _revised_items(spark, sf)
    return target.join(source, ["l_orderkey", "l_linenumber"], "left_anti").select("l_orderkey", "l_linenumber")


def bbox_iou(spark: SparkSession, sf: str) -> DataFrame:
    boxes = fixtures.boxes(fixtures.table(spark, sf, "embeddings"))
    pairs = spatial.neighbours(boxes, geometry.intersects, 9.0)
    named = lambda s: boxes.select(F.col("id").alias(s), F.col("bbox").alias(f"{s}_box"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", _scaled(geometry.iou(F.col("a_box"), F.col("b_box"))).alias("iou"))


def bbox_center_distance(spark: SparkSession, sf: str) -> DataFrame:
    boxes = fixtures.boxes(fixtures.table(spark, sf, "embeddings"))
    pairs = spatial.by_distance(boxes, 3.0)
    return pairs.groupBy("page").agg(F.count("*").alias("pairs"), F.sum(F.col("a") + F.col("b")).alias("ids"))


def clusters_center_distance(spark: SparkSession, sf: str) -> DataFrame:
    boxes = fixtures.boxes(fixtures.table(spark, sf, "embeddings"))
    return spatial.clusters(boxes, spatial.by_distance(boxes, 3.0), cut=checkpointed)


def clusters_iou(spark: SparkSession, sf: str) -> DataFrame:
    boxes = fixtures.boxes(fixtures.table(spark, sf, "embeddings"))
    return spatial.clusters(boxes, spatial.neighbours(boxes, lambda p, q: geometry.iou(p, q) >= 0.2, 9.0), cut=checkpointed)


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    pages = fixtures.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5000 + 500).cast("int").alias("w"), (F.col("o_orderkey") % 4000 + 400).cast("int").alias("h"))
    each = pages.select("o_orderkey", F.explode(geometry.tiles(F.col("w"), F.col("h"), 1536, 0.12)).alias("t"))
    return each.select("o_orderkey", *[F.col(f"t.{c}").cast("long").alias(c) for c in ("row", "col", "x", "y", "width", "height")])


def token_box_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "benchmark").select("item_id", F.explode(recognition.token_boxes(F.col("text"), geometry.box(F.lit(0), F.lit(0), F.lit(1000), F.lit(10)))).alias("t"))
    return rows.select("item_id", F.col("t.text").alias("token"), _scaled(F.col("t.x1")).alias("x1"), _scaled(F.col("t.x2")).alias("x2"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(_gold(spark, sf))


def prf1_by_label(spark: SparkSession, sf: str) -> DataFrame:
    scored = evaluate.precision_recall(evaluate.counts(_gold(spark, sf)))
    return scored.select("label", "tp", "fp", "fn", *[_scaled(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def binary_task(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.binary_tasks(_gold(spark, sf)).select("task", "correct", "total", _scaled(F.col("accuracy")).alias("accuracy"))


def summary_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.totals(_gold(spark, sf)).select("pair_id", "fields", "correct")


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.error_taxonomy(_gold(spark, sf))


def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return _failures(spark, sf).select("pair_id", "field_id", "category", "failure_pattern")


def top_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.top_patterns(_failures(spark, sf))


def first_k_examples(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.examples(_failures(spark, sf)).select("category", "example", "field_id")


def annotation_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = _gold(spark, sf).withColumns({"result_ord": F.col("field_id"), "s_bbox": F.lit(None).cast("double"), "t_bbox": F.lit(None).cast("double")})
    return spatial.annotations(rows).select("pair_id", "field_id", F.col("index").cast("long").alias("index"), "annotation_id")


def badge_placement(spark: SparkSession, sf: str) -> DataFrame:
    boxes = fixtures.boxes(fixtures.table(spark, sf, "embeddings"))
    marks = boxes.select(F.lit(1).cast("long").alias("pair_id"), F.col("page").alias("page_number"), F.col("id").alias("index"), F.col("bbox").alias("anchor"))
    return spatial.badge_places(marks, 1000, 1000)


def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumn("confidence", F.lit(0.88))
    return extract.extract_matches(rows).select("pair_id", "ord", "rule_id", "label", "value")


def extracted_unique_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumn("confidence", F.lit(0.88))
    return extract.extract_fields(rows, ["pair_id", "ord"]).select("pair_id", "ord", "rule_id", "normalized_label", "normalized_value", "field_confidence")


def validate_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return validate.repeated(rows, ["l_orderkey", "l_suppkey"], "l_linenumber").select("l_orderkey", "l_suppkey", "l_linenumber", F.col("occurrence").cast("long").alias("occurrence"))


def grounding_ints(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.table(spark, sf, "documents")
    return docs.select("doc_id", F.size(validate.integers(F.coalesce("text", F.lit("")))).cast("long").alias("integers"))


def stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fixtures.table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("modified"))
    latest = jobs.agg(F.max("modified").alias("now"))
    return validate.stale(jobs.join(F.broadcast(latest)), F.col("now")).select("job_id", F.col("age").cast("long").alias("age"))


def fuzz_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _same_place(spark, sf).select("pair_id", "ord", _scaled(similarity.ratio(F.col("text"), F.col("t_text"))).alias("ratio"))


def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _same_place(spark, sf).select("pair_id", "ord", _scaled(similarity.text_similarity(F.col("text"), F.col("t_text"))).alias("similarity"))


def normalize_value(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("pair_id", "ord", normalize.normalize_value(F.col("text")).alias("normalized"))


def pair_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _fields(spark, sf)
    names = ("label_similarity", "value_similarity", "token_overlap", "regex_compatibility", "composite")
    return matching.candidates(source, target, SERVICE).select("pair_id", "s_ord", "t_ord", *[_scaled(F.col(n)).alias(n) for n in names])


def assign_optimal(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _fields(spark, sf)
    scored = checkpointed(matching.contenders(source, target, SERVICE))
    return matching.assign(scored, source, target, SERVICE)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare(*_fields(spark, sf), SERVICE, cut=checkpointed)


def classify_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).select("pair_id", "s_ord", "t_ord", "match_type", _scaled(F.col("confidence")).alias("confidence"))


def review_flags(spark: SparkSession, sf: str) -> DataFrame:
    return classify.flags(classify.with_certainties(_results(spark, sf))).select("pair_id", "field_reference", "type", "severity", _scaled(F.col("confidence")).alias("confidence"))


def comparison_summary(spark: SparkSession, sf: str) -> DataFrame:
    return classify.summary(_results(spark, sf))


def _difference(spark: SparkSession, sf: str) -> DataFrame:
    source, target = (textdiff.first_of_each(fixtures.with_normalized(x)) for x in _sides(spark, sf))
    return textdiff.difference(source, target, STRICTNESS, cut=checkpointed)


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    return _difference(spark, sf).select("pair_id", "kind", "s_ord", "t_ord", _scaled(F.col("score")).alias("score"))


def text_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return textdiff.summary(_difference(spark, sf))


def recap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return textdiff.recap(_difference(spark, sf)).select("pair_id", F.col("rank").cast("long").alias("rank"), "kind", "category", "risk", "source_snippet", "target_snippet")


def noise_bullets(spark: SparkSession, sf: str) -> DataFrame:
    return textdiff.noise_bullets(_difference(spark, sf)).select("pair_id", F.col("rank").cast("long").alias("rank"), "text", "noise")


def legacy_align(spark: SparkSession, sf: str) -> DataFrame:
    source, target = (x.withColumn("key", F.col("normalized_value")) for x in _fields(spark, sf))
    return matching.sequential_links(source, target).select("pair_id", "s_ord", "t_ord", _scaled(F.col("score")).alias("score"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        norm_ocr_text, noise_filter, noise_likelihood, line_scan_stats, dedupe_keep_first, change_category, change_risk, token_jaccard, value_pattern_kind, regex_compat,
        exact_revision_diff, missing_rows, extra_rows, bbox_iou, bbox_center_distance, clusters_center_distance, clusters_iou, tile_grid, token_box_offsets, confusion_matrix,
        prf1_by_label, binary_task, summary_rollup, error_taxonomy, top_patterns, first_k_examples, annotation_index, badge_placement, extract_fields, extracted_unique_fields,
        validate_duplicates, grounding_ints, stale_jobs, fuzz_ratio, text_similarity, normalize_value, pair_breakdown, assign_optimal, classify_pairs, review_flags,
        comparison_summary, greedy_match, text_diff_summary, recap_topk, noise_bullets, legacy_align,
    )
} | sheets.QUERIES | reports.QUERIES
ORACLE_SQL: dict[str, str] = oracle.SQL | sheets.SQL | reports.SQL

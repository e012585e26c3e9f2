"""Scores of results against gold labels; plain aggregations that merge by addition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions.lines import preview
from palimpsest.schemas import BUCKETS, GOLD_LABELS

#: Categories of failures, in the order of reports (fixed values).
CATEGORIES = ("ocr", "extraction", "matching", "classification")
_GOLD_OF = {"exact_match": "matched", "partial_match": "matched", "changed_value": "changed", "missing_in_target": "missing", "extra_in_target": "extra"}
#: Legacy names of gold labels (fixed values).
LEGACY = {"match": "matched", "exact_match": "matched", "partial_match": "matched", "changed_value": "changed", "missing_in_target": "missing", "extra_in_target": "extra"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def gold_of(match_type: Column) -> Column:
    return _mapped(match_type, _GOLD_OF)


def coerced(label: Column) -> Column:
    return F.coalesce(_mapped(label, LEGACY), label)


def bucket(match_type: Column) -> Column:
    return F.when(match_type.isNull(), "none").otherwise(F.coalesce(gold_of(match_type), F.lit("uncertain")))


def joined(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Gold rows (pair_id, field_id, expected) with the first result that refers to the field, if any."""
    refs = results.withColumn("field_id", F.coalesce("s_field_id", "t_field_id"))
    first = F.row_number().over(W.partitionBy("pair_id", "field_id").orderBy("result_ord"))
    return gold.join(refs.withColumn("_n", first).filter("_n = 1").drop("_n"), ["pair_id", "field_id"], "left")


def _count(label: Column, tp: int, fp: int, fn: int) -> Column:
    return F.struct(label.alias("label"), *[F.lit(v).cast("long").alias(n) for n, v in (("tp", tp), ("fp", fp), ("fn", fn))])


def increments(scored: DataFrame, *by: str) -> DataFrame:
    """(label, tp, fp, fn) of each row of (expected, match_type): one for the gold label, and one for a wrong guess."""
    gold, guess = F.col("expected"), gold_of(F.col("match_type"))
    right = gold == F.coalesce(guess, F.lit(""))
    parts = F.array(F.when(right, _count(gold, 1, 0, 0)).otherwise(_count(gold, 0, 0, 1)), F.when(~right & guess.isNotNull(), _count(guess, 0, 1, 0)))
    return scored.select(*by, F.explode(F.array_compact(parts)).alias("c"))


def counts(scored: DataFrame, *by: str) -> DataFrame:
    """tp, fp and fn of each label over rows of (expected, match_type); every label has a row for each group."""
    zeros = F.array(*[_count(F.lit(g), 0, 0, 0) for g in GOLD_LABELS])
    seen = increments(scored, *by)
    whole = (scored.select(*by).distinct() if by else scored.sparkSession.range(1)).select(*by, F.explode(zeros).alias("c"))
    return seen.unionByName(whole).select(*by, "c.*").groupBy(*by, "label").agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")])


#: Why a gold field failed, by what was found (fixed values).
RATIONALES = {
    "no_row": "No MatchResult row for this field_id — it was not present in extracted fields under the same id, so parsing never produced an alignable row.",
    "extra_no_row": "Target field was extracted but no EXTRA_IN_TARGET row references this id (check field_id consistency with the matcher output).",
    "extracted_no_row": "Field exists on source extraction list but no MatchResult references this field_id.",
    "uncertain": "Greedy alignment produced a pair but composite scores landed in the uncertain band.",
    "missing_paired": "Gold says the value is absent on B, but the matcher linked this source row to a target.",
    "extra_paired": "Gold says target-only extra, but this field was paired with a source row.",
    "not_paired": "Source field exists but no target candidate met min_pair_composite — alignment failure.",
    "low_confidence": "At least one side of the pair has field confidence below {0:.2f} (noisy OCR / weak extraction signal).",
    "matched_changed": "Matcher linked fields but classified values as changed while gold treats them as equivalent.",
    "changed_matched": "Matcher treated values as equivalent; gold expects a semantic change.",
    "other": "Outcome mismatch after alignment; thresholds or similarity features likely need tuning.",
}


def rationale(threshold: float) -> Column:
    """Over failure_pattern and category: why the gold field failed."""
    pattern, text = F.col("failure_pattern"), {k: F.lit(v.format(threshold)) for k, v in RATIONALES.items()}
    return (
        F.when(pattern == "gold_extra_field_in_target_but_no_result_row", text["extra_no_row"])
        .when(pattern == "gold_field_extracted_but_no_match_row", text["extracted_no_row"])
        .when(F.col("category") == "extraction", text["no_row"])
        .when(F.col("category") == "ocr", text["low_confidence"])
        .when(pattern.endswith("_pred_uncertain"), text["uncertain"])
        .when(pattern == "gold_missing_pred_paired", text["missing_paired"])
        .when(pattern == "gold_extra_pred_paired", text["extra_paired"])
        .when(F.col("category") == "matching", text["not_paired"])
        .when(pattern == "gold_matched_pred_changed_value", text["matched_changed"])
        .when(pattern.isin("gold_changed_pred_exact_match", "gold_changed_pred_partial_match"), text["changed_matched"])
        .otherwise(text["other"])
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall(counted: DataFrame) -> DataFrame:
    out = counted.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def run_summary(counted: DataFrame, *by: str) -> DataFrame:
    """Accuracy, and the mean F1 of labels with support."""
    n = F.sum(F.col("tp") + F.col("fn"))
    scored = precision_recall(counted)
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(n.alias("gold_fields"), F.when(n > 0, F.sum("tp") / n).alias("field_accuracy"), F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))).alias("macro_f1"))


def confusion(scored: DataFrame) -> DataFrame:
    """A row for each gold label, a column for each bucket, zero-filled."""
    pivot = scored.select("expected", bucket(F.col("match_type")).alias("bucket")).groupBy("expected").pivot("bucket", list(BUCKETS)).count()
    labels = scored.sparkSession.createDataFrame([(g,) for g in GOLD_LABELS], "expected string")
    return labels.join(pivot, "expected", "left").na.fill(0, list(BUCKETS))


def totals(scored: DataFrame) -> DataFrame:
    """Fields and right ones of each comparison, and of all where pair_id is null."""
    right = F.count_if(F.col("expected") == F.coalesce(gold_of(F.col("match_type")), F.lit("")))
    return scored.rollup("pair_id").agg(F.count("*").alias("fields"), right.alias("correct"))


def with_membership(scored: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Scored rows with in_source and in_target: whether extraction found the field (pair_id, field_id) on that side."""
    out = scored
    for name, side in (("in_source", source), ("in_target", target)):
        found = side.select("pair_id", "field_id").distinct().withColumn(name, F.lit(True))
        out = out.join(found, ["pair_id", "field_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def binary_tasks(scored: DataFrame) -> DataFrame:
    """Accuracy of finding changed and missing fields; null without any."""
    kinds = {"changed_value_detection": ("changed", "changed_value"), "missing_detection": ("missing", "missing_in_target")}
    aggs = []
    for label, kind in kinds.values():
        aggs += [F.count_if(F.col("expected") == label).alias(f"{label}_total"), F.count_if((F.col("expected") == label) & (F.col("match_type") == kind)).alias(f"{label}_correct")]
    rows = F.array(*[F.struct(F.lit(task).alias("task"), F.col(f"{label}_correct").alias("correct"), F.col(f"{label}_total").alias("total")) for task, (label, _) in kinds.items()])
    return scored.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")))


def error_taxonomy(scored: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Category and pattern of every gold row that its result does not satisfy.

    Rows carry in_source and in_target (was the field extracted?), and s_confidence and t_confidence.
    """
    gold, kind = F.col("expected"), F.col("match_type")
    failed = scored.filter(~(gold == F.coalesce(gold_of(kind), F.lit(""))))
    named = lambda tail: F.concat(F.lit("gold_"), gold, F.lit("_pred_"), tail)
    low = F.least("s_confidence", "t_confidence")
    paired = F.col("s_confidence").isNotNull() & F.col("t_confidence").isNotNull()
    same = kind.isin("exact_match", "partial_match")
    missing_row = (
        F.when((gold == "extra") & ~F.col("in_target"), "gold_extra_field_not_in_target_extraction")
        .when(gold == "extra", "gold_extra_field_in_target_but_no_result_row")
        .when(~F.col("in_source"), "gold_field_not_in_source_extraction")
        .otherwise("gold_field_extracted_but_no_match_row")
    )
    # (test, category, pattern), the first that holds counts
    table = [
        (kind.isNull(), "extraction", missing_row),
        (kind == "uncertain", "matching", named(F.lit("uncertain"))),
        ((gold == "missing") & (same | (kind == "changed_value")), "matching", F.lit("gold_missing_pred_paired")),
        ((gold == "extra") & (same | (kind == "changed_value")), "matching", F.lit("gold_extra_pred_paired")),
        (gold.isin("matched", "changed") & (kind == "missing_in_target"), "matching", named(F.lit("missing_in_target"))),
        (paired & (low < threshold), "ocr", F.concat(named(kind), F.lit("_low_field_confidence"))),
        ((gold == "matched") & (kind == "changed_value"), "classification", F.lit("gold_matched_pred_changed_value")),
    ]
    category, pattern = F.lit("classification"), named(kind)
    for test, c, p in reversed(table):
        category, pattern = F.when(test, c).otherwise(category), F.when(test, p).otherwise(pattern)
    return failed.withColumn("category", category).withColumn("failure_pattern", pattern).withColumn("min_field_confidence", low).withColumn("rationale", rationale(threshold))


def category_counts(failures: DataFrame) -> DataFrame:
    """Failures of each category, those without any too, and the comparisons that they are in."""
    found = failures.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("pairs"))
    every = failures.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return every.join(found, "category", "left").na.fill(0, ["n", "pairs"])


def examples(failures: DataFrame, k: int = 8) -> DataFrame:
    """The first k failures of each category."""
    n = F.row_number().over(W.partitionBy("category").orderBy("pair_id", "field_id"))
    return failures.withColumn("example", n).filter(F.col("example") <= k)


def top_patterns(failures: DataFrame, k: int = 20) -> DataFrame:
    return failures.groupBy("failure_pattern").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("pairs")).orderBy(F.desc("n"), "failure_pattern").limit(k)


def previews(failures: DataFrame) -> DataFrame:
    return failures.withColumns({"source_preview": preview(F.col("s_value")), "target_preview": preview(F.col("t_value")), "reason_preview": preview(F.col("reason"), 200)})

"""What reports show of results: captions, titles, percentages, and one row a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles of outcomes and flags, and advice by severity (fixed values).
MATCH_TITLES = {
    "exact_match": "Exact match",
    "partial_match": "Partial match",
    "changed_value": "Changed text",
    "missing_in_target": "Missing on target",
    "extra_in_target": "Only on target",
    "uncertain": "Unclear match",
}
FLAG_TITLES = {
    "missing_information": "Missing information",
    "changed_value": "Text changed",
    "possible_error": "Possible read or pairing error",
    "ambiguous_match": "Unclear or partial match",
    "extra_information": "Extra information on target",
}
SEVERITY_ADVICE = {
    "high": "High — review soon; may affect correctness.",
    "medium": "Medium — worth confirming when you have time.",
    "low": "Low — informational; often safe to ignore.",
}
NO_TEXT, NO_CONFIDENCE = "(no text captured)", "—"
#: Reports that a response carries in its extras, and that no report repeats (fixed values).
EMBEDDED = ("comparison_json_report", "comparison_markdown_report")


def titled(code: Column, titles: dict[str, str]) -> Column:
    """The title of a code; of an unknown one its words."""
    table = F.create_map(*[F.lit(x) for item in titles.items() for x in item])
    return F.coalesce(F.try_element_at(table, code), F.replace(code, F.lit("_"), F.lit(" ")))


def _text(name: str) -> Column:
    """A column's trimmed text; null where it is blank."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def caption(side: str = "") -> Column:
    """Label and value of a field, or what there is of it, or its raw text."""
    label, value = _text(f"{side}label"), _text(f"{side}value")
    return F.coalesce(F.concat(label, F.lit(": "), value), value, label, _text(f"{side}raw_text"), F.lit(NO_TEXT))


def percentage(share: Column) -> Column:
    return F.coalesce(F.concat(F.bround(share * 100).cast("long").cast("string"), F.lit("%")), F.lit(NO_CONFIDENCE))


def confidence_pair(has_source: Column, source: Column, has_target: Column, target: Column) -> Column:
    """Recognition confidences of the sides that there are."""
    sides = F.concat_ws(" / ", F.when(has_source, percentage(source)), F.when(has_target, percentage(target)))
    return F.coalesce(F.nullif(sides, F.lit("")), F.lit(NO_CONFIDENCE))


def pair_rows(results: DataFrame) -> DataFrame:
    """One row a result, from both sides' fields with prefixes s_ and t_ (null ids where there is no side)."""
    source, target = F.col("s_field_id").isNotNull(), F.col("t_field_id").isNotNull()
    label = F.coalesce(*[_text(f"{side}_{name}") for side in "st" for name in ("normalized_label", "label")])
    return results.select(
        "pair_id", "s_ord", "t_ord", label.alias("field_label"),
        F.when(source, caption("s_")).alias("on_source_drawing"), F.when(target, caption("t_")).alias("on_target_drawing"),
        F.bround("confidence", 4).alias("match_confidence"), confidence_pair(source, F.col("s_confidence"), target, F.col("t_confidence")).alias("ocr_confidence"),
        F.col("match_type").alias("technical_match_type"), F.col("reason").alias("technical_notes"),
    )


def legend_counts(annotations: DataFrame) -> DataFrame:
    """How many annotations of each outcome a comparison has, with the outcome's title."""
    return annotations.groupBy("pair_id", "match_type").agg(F.count("*").alias("n")).withColumn("title", titled(F.col("match_type"), MATCH_TITLES))


def without_reports(extras: Column) -> Column:
    """A map of extras without the reports that it embeds."""
    return F.map_filter(extras, lambda k, v: ~k.isin(*EMBEDDED))

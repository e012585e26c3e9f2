"""Fields from tokens, defaults that fill their gaps, and keys to align them by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import normalize


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def token_fields(tokens: DataFrame) -> DataFrame:
    """One unlabelled field a token (document_id, page_number, ord, text, normalized_text, bbox, confidence); ids follow from places."""
    return tokens.select(
        F.concat_ws(":", F.lit("token"), F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("ord").cast("string")).alias("field_id"), F.lit("ocr_token").alias("field_type"),
        F.lit("").alias("label"), F.col("text").alias("value"), F.col("text").alias("raw_text"), F.lit("").alias("normalized_label"), F.col("normalized_text").alias("normalized_value"),
        "page_number", "bbox", "confidence",
    )


def backfilled(rows: DataFrame) -> DataFrame:
    """Fields whose blank raw text, value and normal forms follow from the others, in this order.

    Raw text comes from label and value, the value of an unlabelled field from its raw text, and
    normal forms from label and value.
    """
    label, value = (F.coalesce(n, F.lit("")) for n in ("label", "value"))
    joined = F.btrim(F.trim(F.concat(label, F.lit(": "), value)), F.lit(":"))
    first = rows.withColumn("raw_text", F.when(_blank(F.col("raw_text")), F.when((label != "") | (value != ""), joined).otherwise("")).otherwise(F.col("raw_text")))
    second = first.withColumn("value", F.when(_blank(F.col("value")) & _blank(F.col("label")), F.col("raw_text")).otherwise(F.coalesce("value", F.lit(""))))
    filled = lambda own, made: F.when(_blank(F.trim(own)), made).otherwise(F.trim(own))
    return second.withColumns(
        {
            "normalized_value": filled(F.col("normalized_value"), normalize.normalize_value(F.col("value"))),
            "normalized_label": filled(F.col("normalized_label"), normalize.normalize_label(F.col("label"))),
        }
    )


def comparison_key() -> Column:
    """Of filled fields: normal label and value with a bar between if both texts are there, else the normal value, label, or text."""
    side = lambda name: F.replace(F.col(f"normalized_{name}"), F.lit("|"), F.lit("/"))
    given = lambda name: F.nullif(F.coalesce(name, F.lit("")), F.lit(""))
    whole = normalize.ocr_text(F.coalesce(given("raw_text"), given("value"), given("label"), F.lit("")))
    return F.when(~_blank(F.col("label")) & ~_blank(F.col("value")), F.concat(side("label"), F.lit("|"), side("value"))).otherwise(F.coalesce(given("normalized_value"), given("normalized_label"), whole))

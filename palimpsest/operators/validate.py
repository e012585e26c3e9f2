"""Checks of manifests and annotations, and of generated text against a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.schemas import MATCH_TYPES


def repeated(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The second and later rows of each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return rows.withColumn("occurrence", n).filter("occurrence > 1")


def _message(severity: str, *parts: Column | str) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("message")]


def check_manifest(manifest: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """(severity, message) of a manifest (row, pair_id, drawing_a_ref, drawing_b_ref), exploded annotations (pair_id, row, field_id, own_pair_id) and known files (path)."""
    found = repeated(manifest, ["pair_id"], "row").select(*_message("error", "duplicate pair_id ", F.col("pair_id"), " at row ", F.col("row").cast("string")))
    refs = manifest.select("pair_id", F.explode(F.array("drawing_a_ref", "drawing_b_ref")).alias("path"))
    missing = refs.join(files, "path", "left_anti").select(*_message("error", "missing file ", F.col("path"), " of ", F.col("pair_id")))
    fields = repeated(annotations, ["pair_id", "field_id"], "row").select(*_message("error", "duplicate field_id ", F.col("field_id"), " in ", F.col("pair_id")))
    other = annotations.filter(F.col("own_pair_id") != F.col("pair_id")).select("pair_id", "own_pair_id").distinct().select(*_message("error", "annotation of ", F.col("pair_id"), " names ", F.col("own_pair_id")))
    none = manifest.join(annotations, "pair_id", "left_anti").select(*_message("warning", "no annotation for ", F.col("pair_id")))
    return found.unionByName(missing).unionByName(fields).unionByName(other).unionByName(none)


def integers(text: Column) -> Column:
    """Distinct whole numbers that are no part of a decimal."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![\d.])\d+(?![\d]|\.\d)"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda r: F.regexp_replace(r, "^0+(?=.)", "")))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def outcomes(text: Column) -> Column:
    """Match types that a text names, with underscores or spaces."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(m) for m in MATCH_TYPES]), lambda m: low.contains(m) | low.contains(F.replace(m, F.lit("_"), F.lit(" "))))


def ungrounded(summary: Column, report: Column) -> Column:
    """Whole numbers and outcomes of a summary that its report does not hold."""
    return F.concat(F.array_except(integers(summary), integers(report)), F.array_except(outcomes(summary), outcomes(report)))


def bullets(text: Column) -> Column:
    """The bullet lines of a text, without their marks."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+\S"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", "")))


def stale(jobs: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """Jobs (job_id, modified) older than their time to live."""
    return jobs.withColumn("age", F.unix_timestamp(now) - F.unix_timestamp("modified")).filter(F.col("age") > ttl_seconds)

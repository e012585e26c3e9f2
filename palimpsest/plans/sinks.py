"""Reports as rows and files: JSON documents, Markdown, and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.lines import decimals
from palimpsest.operators.display import percentage
from palimpsest.scratch import merged

SECTIONS = {"changed_value": "changed", "partial_match": "partial", "missing_in_target": "missing", "extra_in_target": "extra", "uncertain": "uncertain"}


def section(match_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, name in SECTIONS.items():
        out = F.when(match_type == kind, name).otherwise(out)
    return out


def json_reports(results: DataFrame, summary: DataFrame, flagged: DataFrame) -> DataFrame:
    """One JSON document a comparison: summary, sections in order of place, flags. Sections hold a comparison's own rows only."""
    row = F.struct("s_ord", "t_ord", "s_field_id", "t_field_id", "match_type", F.round("confidence", 4).alias("confidence"), "reason")
    by_section = results.withColumn("section", section(F.col("match_type"))).filter("section is not null").groupBy("pair_id", "section").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    sections = by_section.groupBy("pair_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "rows")))).alias("sections"))
    flags = flagged.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("field_reference", "type", "severity", "reason", "confidence"))).alias("flags"))
    whole = summary.join(merged(sections), "pair_id", "left").join(merged(flags), "pair_id", "left")
    counts = F.struct(*[c for c in summary.columns if c != "pair_id"])
    return whole.select("pair_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), counts.alias("summary"), "sections", "flags"), {"ignoreNullFields": "true"}).alias("report"))


def cell(text: Column) -> Column:
    """Text for a Markdown table cell."""
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def markdown_rows(results: DataFrame) -> DataFrame:
    """A table line a result, reasons cut at 200 characters."""
    line = F.concat_ws(" | ", cell(F.col("match_type")), cell(F.col("s_value")), cell(F.col("t_value")), percentage(F.col("confidence")), cell(F.substring("reason", 1, 200)))
    return results.select("pair_id", "s_ord", "t_ord", F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def executive_sentence(summary: DataFrame) -> DataFrame:
    """Counts in words; kinds without any are left out."""
    names = {"matched": "matched", "changed": "changed", "missing": "missing in the target", "extra": "only in the target", "uncertain": "uncertain"}
    parts = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}"))) for c, text in names.items()]
    return summary.select("pair_id", F.concat(F.col("total_source").cast("string"), F.lit(" source fields: "), F.concat_ws("; ", *parts)).alias("sentence"))


def fixed(c: Column, places: int = 6) -> Column:
    """A number with fixed places, or nothing."""
    return F.coalesce(decimals(c, places), F.lit(""))


def write_evaluation(path: str, labels: DataFrame, matrix: DataFrame, summary: DataFrame) -> None:
    """Per-label scores, confusion matrix and summary, as CSV and JSON below a folder."""
    labels.select("label", "tp", "fp", "fn", *[fixed(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]).coalesce(1).write.csv(f"{path}/labels", header=True)
    matrix.coalesce(1).write.csv(f"{path}/confusion", header=True)
    summary.coalesce(1).write.json(f"{path}/summary")


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON line a comparison."""
    reports.write.json(path)


MOST_FAILURES = 500


def error_analysis(failures: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """One JSON document of a run's failures: the first of them, how many were left out, and counts by category and pattern.

    The list is what a reader gets to see, so its length is the feature; all counts are of all failures.
    """
    names = ["pair_id", "field_id", "expected", "match_type", "category", "failure_pattern"]
    shown = failures.select(*names).orderBy("pair_id", "field_id").limit(most).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("failures"))
    whole = failures.agg(F.count("*").alias("total_failures"), F.countDistinct("pair_id").alias("pairs_with_failures"))
    by = lambda c, n: failures.groupBy(c).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias(n))
    one = F.lit(1).alias("one")
    parts = [x.select("*", one) for x in (whole, by("category", "failures_by_category"), by("failure_pattern", "pattern_counts"), shown)]
    row = parts[0]
    for part in parts[1:]:
        row = row.join(part, "one")
    row = row.withColumn("failures_omitted_count", F.greatest(F.col("total_failures") - most, F.lit(0))).drop("one")
    return row.select("total_failures", "failures_omitted_count", F.to_json(F.struct(*[F.col(c) for c in row.columns])).alias("report"))


#: Rows of a table in a Markdown report of text differences (fixed value).
MOST_ROWS = 120
HEADINGS = {"changed": "Changed", "missing": "Missing", "extra": "Extra"}


def text_diff_markdown(diff: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """A Markdown document for each comparison of lines: counts, then a table of each kind, cut at so many rows with a note of the rest."""
    from pyspark.sql.window import Window as W

    place = W.partitionBy("pair_id", "kind").orderBy(F.coalesce("s_ord", "t_ord"), "t_ord")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("s_text")), cell(F.col("t_text")), F.coalesce(decimals(F.col("score"), 1), F.lit("-"))), F.lit(" |"))
    rows = diff.filter("kind <> 'matched'").select("pair_id", "kind", F.row_number().over(place).alias("n"), line.alias("line"))
    table = rows.groupBy("pair_id", "kind").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "line")))).alias("lines"), F.count("*").alias("all"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    rest = F.when(F.col("all") > most, F.concat(F.lit("\n_… "), (F.col("all") - most).cast("string"), F.lit(" more_"))).otherwise("")
    title = F.create_map(*[F.lit(x) for item in HEADINGS.items() for x in item])[F.col("kind")]
    section = F.concat(F.lit("## "), title, F.lit("\n\n| Source | Target | Score |\n| --- | --- | --- |\n"), body, rest)
    order = F.array_position(F.array(*[F.lit(k) for k in HEADINGS]), F.col("kind"))
    sections = table.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("text")))).alias("parts"))
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    counted = diff.groupBy("pair_id").agg(*[n(k) for k in ("matched", *HEADINGS)])
    summary = F.concat(F.lit("# Text differences\n\n| Kind | Count |\n| --- | --- |\n"), F.concat_ws("\n", *[F.concat(F.lit(f"| {k} | "), F.col(k).cast("string"), F.lit(" |")) for k in ("matched", *HEADINGS)]))
    texts = F.coalesce(F.transform("parts", lambda p: p["text"]), F.array().cast("array<string>"))
    return counted.join(merged(sections), "pair_id", "left").select("pair_id", F.array_join(F.concat(F.array(summary), texts), "\n\n").alias("markdown"))


def provider_benchmark(metrics: DataFrame, errors: DataFrame) -> DataFrame:
    """One JSON document of providers' figures, failed ones (provider, error) included, and their ranking by text found, then confidence."""
    good = metrics.withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
    rows = good.unionByName(errors.select("provider", "error").withColumn("ok", F.lit(False)), allowMissingColumns=True)
    rank = F.struct((-F.col("normalized_chars")).alias("n"), (-F.coalesce("mean_confidence", F.lit(0.0))).alias("c"), "provider")
    gathered = rows.agg(
        F.array_sort(F.collect_list(F.struct("provider", *[c for c in rows.columns if c != "provider"]))).alias("rows"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ok") & (F.col("tokens") > 0), rank))), lambda r: r["provider"]).alias("ranking"),
    )
    return gathered.select("ranking", F.to_json(F.struct("rows", "ranking")).alias("report"))


#: What each count of a summary means to a reader, in the order of the table (fixed values).
MEASURES = (
    ("total_source", "Fields on source drawing", "How many fields we tried to match"),
    ("matched", "Matched closely", "Text lines that lined up well"),
    ("changed", "Text changed", "Same slot, different wording or values"),
    ("missing", "Missing on target", "Present on source, not found on target"),
    ("extra", "Only on target", "Found on target, not on source"),
    ("uncertain", "Unclear matches", "System was unsure—needs a person"),
)
#: Sections of results, with what stands there if one is empty (fixed values).
RESULT_SECTIONS = (
    ("changed_value", "Changed values", "_No changed values were flagged._"),
    ("missing_in_target", "Missing on target", "_Nothing flagged as missing._"),
    ("extra_in_target", "Only on target", "_Nothing flagged as extra._"),
    ("partial_match", "Partial matches", "_No partial matches._"),
    ("uncertain", "Uncertain matches", "_No uncertain matches._"),
)
NO_FLAGS = "_No review flags._"


def _table(*heads: str) -> str:
    return f"| {' | '.join(heads)} |\n|{' --- |' * len(heads)}\n"


def markdown_reports(rows: DataFrame, summary: DataFrame, flagged: DataFrame) -> DataFrame:
    """A Markdown document a comparison: at a glance, counts, five sections of results (display.pair_rows), and review flags.

    Rows of a section stand in order of place; reasons of flags are cut at 200 characters.
    """
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.coalesce(c, F.lit("—"))) for c in ("on_source_drawing", "on_target_drawing")], percentage(F.col("match_confidence")), cell(F.col("ocr_confidence"))), F.lit(" |"))
    by_kind = rows.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("technical_match_type") == k, F.struct(F.coalesce("s_ord", "t_ord").alias("o"), "t_ord", line.alias("line"))))).alias(f"rows_{k}") for k, _, _ in RESULT_SECTIONS])
    flag = F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "type", cell(F.col("field_reference")), cell(F.substring("reason", 1, 200))), F.lit(" |"))
    flags = flagged.groupBy("pair_id").agg(F.array_sort(F.collect_list(flag)).alias("flags"))
    whole = summary.join(executive_sentence(summary), "pair_id").join(by_kind, "pair_id", "left").join(flags, "pair_id", "left")
    counts = F.concat(F.lit("## Summary counts\n\n" + _table("Measure", "Count", "What it means")), F.concat_ws("\n", *[F.concat(F.lit(f"| {name} | "), F.col(c).cast("string"), F.lit(f" | {text} |")) for c, name, text in MEASURES]))
    parts = [F.concat(F.lit("# Drawing comparison report\n\n## At a glance\n\n"), F.col("sentence")), counts]
    for kind, name, none in RESULT_SECTIONS:
        body = F.array_join(F.transform(f"rows_{kind}", lambda x: x["line"]), "\n")
        parts.append(F.when(F.coalesce(F.size(f"rows_{kind}"), F.lit(0)) > 0, F.concat(F.lit(f"## {name}\n\n" + _table("Source text", "Target text", "Match confidence", "OCR confidence")), body)).otherwise(F.lit(f"## {name}\n\n{none}")))
    parts.append(F.when(F.col("flags").isNotNull(), F.concat(F.lit("## Review flags\n\n" + _table("Severity", "Type", "Field", "Detail")), F.array_join("flags", "\n"))).otherwise(F.lit(f"## Review flags\n\n{NO_FLAGS}")))
    return whole.select("pair_id", F.concat_ws("\n\n", *parts).alias("markdown"))


JOB_ID = "^[a-f0-9]{32}$"
#: Artifacts that may be fetched, by suffix, with their media types (fixed values).
MEDIA_TYPES = {"json": "application/json", "md": "text/markdown", "pdf": "application/pdf", "png": "image/png", "html": "text/html", "csv": "text/csv"}


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Artifacts (job_id, name, content) below a folder a job; jobs without a proper id are an error."""
    if not artifacts.filter(~F.coalesce(F.col("job_id").rlike(JOB_ID), F.lit(False))).isEmpty():
        raise ValueError("job ids are 32 hexadecimal digits")
    artifacts.withColumn("media_type", media_type(F.col("name"))).write.mode("append").partitionBy("job_id").parquet(path)


def media_type(name: Column) -> Column:
    """The media type that a name's suffix stands for; null for those that may not be fetched."""
    suffix = F.lower(F.substring_index(name, ".", -1))
    return F.try_element_at(F.create_map(*[F.lit(x) for item in MEDIA_TYPES.items() for x in item]), suffix)


def artifact(spark: SparkSession, path: str, job_id: str, name: str) -> DataFrame:
    """One artifact of a job, if it may be fetched."""
    return spark.read.parquet(path).filter((F.col("job_id") == job_id) & (F.col("name") == name) & F.col("media_type").isNotNull())

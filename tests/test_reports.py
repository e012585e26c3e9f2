import json

import pytest
from pyspark.sql import functions as F

from palimpsest.config import CompareConfig, FlagConfig, first_given, from_environment
from palimpsest.operators import batch, compare, display, evaluate
from palimpsest.plans import sinks
from palimpsest.sources import manifests


def test_settings_of_a_deployment():
    assert FlagConfig.service().uncertain_high == pytest.approx(0.43) and FlagConfig.service(0.4).uncertain_high == 0.35
    assert from_environment(CompareConfig, {"APP_LABEL_WEIGHT": "0.5", "APP_CROSS_PAGE": "yes", "OTHER": "1"}, "app_") == CompareConfig(label_weight=0.5, cross_page=True)
    assert from_environment(FlagConfig, {"X_CRITICAL_TYPES": "a,b"}, "X_").critical_types == ("a", "b")
    assert first_given(None, "  ", " k ", "z") == "k" and first_given("") is None


def test_failures_are_rows(spark):
    def one(group):
        if 2 in group.n.tolist():
            raise KeyError("two")
        return group.groupby("pair_id", as_index=False).agg(total=("n", "sum"))

    rows = spark.createDataFrame([(1, 1), (1, 5), (2, 2), (3, 3)], "pair_id long, n long")
    got = {r.pair_id: (r.total, r.error) for r in batch.applied(rows, one, "total long").collect()}
    assert got == {1: (6, None), 2: (None, "KeyError: 'two'"), 3: (3, None)}


def test_outcomes_name_the_first_reason(spark):
    pairs = spark.createDataFrame([(i,) for i in range(5)], "pair_id long")
    gold = spark.createDataFrame([(0, 1, "matched"), (0, 2, "changed"), (3, 1, "matched"), (4, 1, "extra")], "pair_id long, field_id long, expected string")
    results = spark.createDataFrame([(0, 1, 1, "exact_match", 0), (0, 2, 2, "exact_match", 1)], "pair_id long, s_field_id long, t_field_id long, match_type string, result_ord long")
    errors = spark.createDataFrame([(3, "ValueError: x"), (1, "never seen")], "pair_id long, error string")
    rows = batch.outcomes(pairs, pairs.filter("pair_id <> 1"), gold, results, errors)
    got = {r.pair_id: tuple(r)[1:] for r in rows.collect()}
    assert got == {0: (True, None, 2, 1), 1: (False, batch.NO_ANNOTATION, None, None), 2: (False, batch.NO_FIELDS, None, None), 3: (False, "ValueError: x", None, None), 4: (True, None, 1, 0)}
    assert tuple(batch.run_totals(rows).first()) == (5, 2, 3, 3, 1)


def test_results_are_numbered(spark):
    rows = spark.createDataFrame([(1, None, 4), (1, 2, None), (1, 1, 3), (1, 0, 7), (2, None, 0)], "pair_id long, s_ord long, t_ord long")
    got = {(r.pair_id, r.s_ord, r.t_ord): r.result_ord for r in compare.ordered_results(rows).collect()}
    assert got == {(1, 0, 7): 0, (1, 1, 3): 1, (1, 2, None): 2, (1, None, 4): 3, (2, None, 0): 0}


def test_captions_and_titles(spark):
    rows = [("L", "V", ""), (" ", "V", ""), ("L", None, ""), (None, "", " r "), (None, None, None)]
    df = spark.createDataFrame(rows, "label string, value string, raw_text string")
    assert sorted(r[0] for r in df.select(display.caption()).collect()) == sorted(["L: V", "V", "L", "r", "(no text captured)"])
    one = spark.range(1).select(
        display.titled(F.lit("changed_value"), display.FLAG_TITLES).alias("a"), display.titled(F.lit("own_kind"), display.MATCH_TITLES).alias("b"), display.percentage(F.lit(0.125)).alias("c"), display.percentage(F.lit(None).cast("double")).alias("d"),
        display.confidence_pair(F.lit(False), F.lit(0.5), F.lit(False), F.lit(0.5)).alias("e"), display.confidence_pair(F.lit(True), F.lit(None).cast("double"), F.lit(True), F.lit(1.0)).alias("f"),
    )
    assert tuple(one.first()) == ("Text changed", "own kind", "12%", "—", "—", "— / 100%")


def test_markdown_report(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, "exact_match", "a", "a", 1.0, "90% / 80%"), (1, 1, 2, "changed_value", "x|y", "x\nz", 0.756, "—"), (1, 2, None, "missing_in_target", "gone", None, 1.0, "70%"), (2, 0, 0, "exact_match", "b", "b", 1.0, "—")],
        "pair_id long, s_ord long, t_ord long, technical_match_type string, on_source_drawing string, on_target_drawing string, match_confidence double, ocr_confidence string",
    )
    summary = spark.createDataFrame([(1, 3, 1, 1, 1, 0, 0), (2, 1, 1, 0, 0, 0, 0)], "pair_id long, total_source long, matched long, changed long, missing long, extra long, uncertain long")
    flags = spark.createDataFrame([(1, "s:1:1", "changed_value", "high", "r" * 300, 0.7)], "pair_id long, field_reference string, type string, severity string, reason string, confidence double")
    got = {r.pair_id: r.markdown for r in sinks.markdown_reports(rows, summary, flags).collect()}
    heads = [x for x in got[1].split("\n") if x.startswith("#")]
    assert heads == ["# Drawing comparison report", "## At a glance", "## Summary counts", "## Changed values", "## Missing on target", "## Only on target", "## Partial matches", "## Uncertain matches", "## Review flags"]
    assert "| x\\|y | x z | 76% | — |" in got[1] and "| gone | — | 100% | 70% |" in got[1] and "_Nothing flagged as extra._" in got[1]
    assert f"| high | changed_value | s:1:1 | {'r' * 200} |" in got[1] and "3 source fields: 1 matched; 1 changed; 1 missing in the target" in got[1]
    assert got[2].endswith("_No review flags._") and "_No changed values were flagged._" in got[2]


def test_error_analysis_counts_all_but_lists_some(spark):
    rows = spark.createDataFrame([(i, i, "matched", None, "ocr" if i % 2 else "matching", f"p{i % 3}") for i in range(10)], "pair_id long, field_id long, expected string, match_type string, category string, failure_pattern string")
    r = sinks.error_analysis(rows, 4).first()
    report = json.loads(r.report)
    assert (r.total_failures, r.failures_omitted_count, len(report["failures"])) == (10, 6, 4)
    assert report["failures_by_category"] == {"matching": 5, "ocr": 5} and report["pattern_counts"] == {"p0": 4, "p1": 3, "p2": 3} and report["pairs_with_failures"] == 10
    assert {x.category: x.n for x in evaluate.category_counts(rows).collect()} == {"ocr": 5, "extraction": 0, "matching": 5, "classification": 0}


def test_provider_benchmark_lists_failures_but_ranks_none(spark):
    metrics = spark.createDataFrame([("a", 3, 10, 9, 0.5, 0.1), ("b", 3, 12, 9, 0.9, 0.2), ("c", 0, 0, 0, None, None)], "provider string, tokens long, chars long, normalized_chars long, mean_confidence double, least_confidence double")
    errors = spark.createDataFrame([("cloud", "not_implemented: x")], "provider string, error string")
    r = sinks.provider_benchmark(metrics, errors).first()
    assert r.ranking == ["b", "a"] and [x["ok"] for x in json.loads(r.report)["rows"]] == [True, True, True, False]


def test_artifacts(spark, tmp_path):
    job, path = "0123456789abcdef" * 2, str(tmp_path / "jobs")
    rows = spark.createDataFrame([(job, "report.json", "{}"), (job, "own.exe", "x")], "job_id string, name string, content string")
    sinks.write_artifacts(rows, path)
    assert sinks.artifact(spark, path, job, "report.json").first().media_type == "application/json"
    assert sinks.artifact(spark, path, job, "own.exe").isEmpty() and sinks.artifact(spark, path, "f" * 32, "report.json").isEmpty()
    with pytest.raises(ValueError):
        sinks.write_artifacts(rows.withColumn("job_id", F.lit("../x")), path)


def test_numbers_that_are_missing_leave_nothing(spark):
    assert [r[0] for r in spark.createDataFrame([(1.5,), (None,)], "x double").select(sinks.fixed(F.col("x"), 2)).collect()] == ["1.50", ""]


def test_manifest_index_and_pairs_without_annotation(spark, tmp_path):
    assert manifests.index(spark, str(tmp_path)) is None
    (tmp_path / "index.json").write_text(json.dumps({"manifests": ["a.json"]}))
    assert manifests.index(spark, str(tmp_path)).first().manifests == ["a.json"]
    pairs = spark.createDataFrame([(1,), (2,)], "pair_id long")
    fields = spark.createDataFrame([(1, "f"), (1, "g")], "pair_id long, field_id string")
    assert sorted((r.pair_id, r.field_id or "", r.failed) for r in manifests.with_annotations(pairs, fields).collect()) == [(1, "f", False), (1, "g", False), (2, "", True)]

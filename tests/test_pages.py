from pyspark.sql import functions as F

from palimpsest.operators import pages


def test_pages_and_slices(spark):
    side = lambda n: spark.createDataFrame([(1, i) for i in range(1, n + 1)], "pair_id long, page_number int")
    slices = pages.aligned(side(2), side(1))
    assert sorted((r.slice, r.s_page, r.t_page) for r in slices.collect()) == [(1, 1, 1), (2, 2, None)]
    rows = [(1, "missing_in_target", 2, None), (1, "extra_in_target", None, 1), (1, "changed_value", 1, 1), (1, "changed_value", 2, 1), (1, "extra_in_target", None, 2)]
    results = spark.createDataFrame(rows, "pair_id long, match_type string, s_page_number int, t_page_number int")
    assert sorted((r.match_type, r.slice) for r in pages.sliced(results, slices).collect()) == [("changed_value", 1), ("extra_in_target", 1), ("missing_in_target", 2)]


def test_providers(spark):
    tokens = spark.createDataFrame([("a", "x", "x", 0.5), ("b", "long", "long", 0.9), ("b", "y", "y", 0.7)], "provider string, text string, normalized_text string, confidence double")
    got = pages.ranked_providers(pages.provider_metrics(tokens)).collect()
    assert [(r.provider, r.tokens, r.normalized_chars, r.least_confidence) for r in got] == [("b", 2, 5, 0.7), ("a", 1, 1, 0.5)]
    row = spark.range(1).select(pages.model_cost(F.lit(1000), F.lit(500), F.lit(2.0), F.lit(4.0)).alias("c"), pages.model_cost(F.lit(None).cast("int"), F.lit(1), F.lit(1.0), F.lit(1.0)).alias("n")).first()
    assert row.c == 0.004 and row.n is None

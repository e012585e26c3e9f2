"""Pages of two revisions side by side, results on them, and figures of recognition providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pages (pair_id, page_number) of both sides by number; where one side is shorter its page is null."""
    a = source.select("pair_id", "page_number", F.col("page_number").alias("s_page"))
    b = target.select("pair_id", "page_number", F.col("page_number").alias("t_page"))
    return a.join(b, ["pair_id", "page_number"], "full_outer").withColumnRenamed("page_number", "slice")


def sliced(results: DataFrame, slices: DataFrame) -> DataFrame:
    """Results on the first page pair that shows them: extras by target page, missing ones by source page, the others by both; results on no page go."""
    kind = F.col("match_type")
    shows = (
        F.when(kind == "extra_in_target", F.col("r.t_page_number") == F.col("p.t_page"))
        .when(kind == "missing_in_target", F.col("r.s_page_number") == F.col("p.s_page"))
        .otherwise((F.col("r.s_page_number") == F.col("p.s_page")) & (F.col("r.t_page_number") == F.col("p.t_page")))
    )
    page = F.coalesce("s_page_number", "t_page_number")
    first = results.withColumn("_page", F.when(kind == "extra_in_target", F.col("t_page_number")).otherwise(page))
    joined = first.alias("r").join(slices.alias("p"), (F.col("r.pair_id") == F.col("p.pair_id")) & (F.col("r._page") == F.col("p.slice")) & shows)
    return joined.select("r.*", F.col("p.slice").alias("slice")).drop("_page")


def provider_metrics(tokens: DataFrame) -> DataFrame:
    """Tokens, characters, and mean and least confidence by provider, from (provider, text, normalized_text, confidence)."""
    return tokens.groupBy("provider").agg(
        F.count("*").alias("tokens"), F.sum(F.char_length("text")).alias("chars"), F.sum(F.char_length("normalized_text")).alias("normalized_chars"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("least_confidence")
    )


def ranked_providers(metrics: DataFrame) -> DataFrame:
    """Providers that found anything, those with most text first."""
    return metrics.filter(F.col("tokens") > 0).orderBy(F.desc("normalized_chars"), F.desc("mean_confidence"), "provider")


def model_cost(prompt_tokens: Column, answer_tokens: Column, prompt_price: Column, answer_price: Column) -> Column:
    """Cost from prices a million tokens, to six places; null if any part is missing."""
    return F.bround((prompt_tokens * prompt_price + answer_tokens * answer_price) / 1_000_000, 6)

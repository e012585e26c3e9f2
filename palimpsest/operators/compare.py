"""The comparison of two revisions, from records to results, in one plan for many comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.config import CompareConfig
from palimpsest.operators import classify, matching
from palimpsest.scratch import merged

_ONE_SIDED = ("field_id", "field_type", "label", "value", "normalized_label", "normalized_value", "page_number")


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select("pair_id", F.col("ord").alias(f"{side}_ord"), *[F.col(c).alias(f"{side}_{c}") for c in _ONE_SIDED])


def _alone(df: DataFrame, links: DataFrame, side: str, kind: str) -> DataFrame:
    return _side(matching.unmatched(df, links, side), side).withColumns({"match_type": F.lit(kind), "confidence": F.lit(1.0), "reason": F.lit(f"classification={kind}")})


def compare(source: DataFrame, target: DataFrame, cfg: CompareConfig, *, cut) -> DataFrame:
    """Results with both sides, outcome, confidence and reason; ``cut`` ends the lineage of what is used twice."""
    scored = cut(matching.contenders(source, target, cfg))
    links = cut(matching.assign(scored, source, target, cfg))
    signals = ["label_similarity", "value_similarity", "token_overlap", "regex_compatibility", "composite", "labels_absent"]
    linked = classify.classified(links.join(merged(scored.select("pair_id", "s_ord", "t_ord", *signals)), ["pair_id", "s_ord", "t_ord"]), cfg)
    paired = linked.join(merged(_side(source, "s")), ["pair_id", "s_ord"]).join(merged(_side(target, "t")), ["pair_id", "t_ord"])
    out = paired.unionByName(_alone(source, links, "s", "missing_in_target"), allowMissingColumns=True)
    return out.unionByName(_alone(target, links, "t", "extra_in_target"), allowMissingColumns=True)


def ordered_results(results: DataFrame) -> DataFrame:
    """Results with ``result_ord`` from 0 within a comparison: links by source and target place, then missing, then extra ones.

    Comparisons are numbered apart from each other, so the numbers need no global order.
    """
    part = F.when(F.col("s_ord").isNull(), 2).when(F.col("t_ord").isNull(), 1).otherwise(0)
    return results.withColumn("result_ord", F.row_number().over(W.partitionBy("pair_id").orderBy(part, "s_ord", "t_ord")) - 1)


def exact_revision_diff(source: DataFrame, target: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Full outer difference of two revisions of keyed rows: same, changed, missing or extra."""
    a = source.select(*keys, value.alias("source_value"), F.lit(True).alias("in_source"))
    b = target.select(*keys, value.alias("target_value"), F.lit(True).alias("in_target"))
    joined = a.join(b, keys, "full_outer")
    kind = (
        F.when(F.col("in_target").isNull(), "missing_in_target")
        .when(F.col("in_source").isNull(), "extra_in_target")
        .when(F.col("source_value").eqNullSafe(F.col("target_value")), "exact_match")
        .otherwise("changed_value")
    )
    return joined.select(*keys, "source_value", "target_value", kind.alias("match_type"))

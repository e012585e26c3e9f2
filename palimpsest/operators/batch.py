"""Evaluation of many pairs, where a pair that fails becomes a row and not the end of the run."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import evaluate

NO_ANNOTATION, NO_FIELDS = "Annotation file not found or not readable", "Annotation has no fields to score"


def isolated(one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``one``, a function of a pair's rows, with its errors as a row: null results and ``error``, its type and text.

    ``schema`` names the columns of one's result; the caller's adds pair_id in front and error behind.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pair = group.pair_id.iloc[0]
        try:
            found = one(group)
        except Exception as error:  # any error is the pair's own
            return pd.DataFrame([[pair, *[None] * len(names), f"{type(error).__name__}: {error}"]], columns=["pair_id", *names, "error"])
        return pd.DataFrame({"pair_id": pair, **{n: found[n] for n in names}, "error": None})

    return run


def applied(rows: DataFrame, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function on the rows of each pair (pair_id), failures as rows."""
    kind = rows.schema["pair_id"].dataType.simpleString()
    return rows.groupBy("pair_id").applyInPandas(isolated(one, schema), f"pair_id {kind}, {schema}, error string")


def outcomes(manifest: DataFrame, annotated: DataFrame, gold: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """One row a pair of the manifest: whether it could be scored, why not, and how many fields are right.

    ``annotated`` (pair_id) has the pairs with an annotation, ``gold`` its fields, ``results`` the
    predictions, and ``errors`` (pair_id, error) the pairs whose comparison failed. The first
    reason that holds counts: no annotation, no fields, an error.
    """
    scored = evaluate.joined(gold, results).withColumn("right", F.col("expected") == F.coalesce(evaluate.gold_of(F.col("match_type")), F.lit("")))
    totals = scored.groupBy("pair_id").agg(F.count("*").alias("fields_total"), F.count_if("right").alias("fields_correct"))
    found = annotated.select("pair_id").distinct().withColumn("annotated", F.lit(True))
    failed = errors.groupBy("pair_id").agg(F.min("error").alias("error"))
    whole = manifest.select("pair_id").join(found, "pair_id", "left").join(totals, "pair_id", "left").join(failed, "pair_id", "left")
    reason = F.when(F.col("annotated").isNull(), NO_ANNOTATION).when(F.col("fields_total").isNull(), NO_FIELDS).otherwise(F.col("error"))
    kept = lambda c: F.when(reason.isNull(), F.col(c))
    return whole.select("pair_id", reason.isNull().alias("success"), reason.alias("error_message"), kept("fields_total").alias("fields_total"), kept("fields_correct").alias("fields_correct"))


def run_totals(rows: DataFrame) -> DataFrame:
    """Pairs attempted, scored and failed, and their fields."""
    return rows.agg(
        F.count("*").alias("pairs_attempted"), F.count_if("success").alias("pairs_succeeded"), F.count_if(~F.col("success")).alias("pairs_failed"),
        F.coalesce(F.sum("fields_total"), F.lit(0)).alias("fields_total"), F.coalesce(F.sum("fields_correct"), F.lit(0)).alias("fields_correct"),
    )

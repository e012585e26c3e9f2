"""Running evaluation counts over a stream of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import evaluate

SCHEMA = "pair_id long, expected string, match_type string"


def scored_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of JSON files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def running_counts(stream: DataFrame) -> DataFrame:
    """tp, fp and fn of each label so far; the state is one row a label."""
    return evaluate.increments(stream).select("c.*").groupBy("label").agg(*[F.sum(n).cast("long").alias(n) for n in ("tp", "fp", "fn")])


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counts in a memory table of that name."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

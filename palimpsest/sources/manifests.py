"""Manifests of golden pairs, their annotations, and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators.evaluate import coerced


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a manifest, with row numbers: a bare array, or an object that wraps one in ``pairs``."""
    raw = spark.read.json(path, multiLine=True)
    rows = raw
    if "pairs" in raw.columns:
        rows = raw.select(F.posexplode("pairs").alias("row", "p")).select("row", "p.*")
    elif "pair_id" in raw.columns:
        rows = raw.withColumn("row", F.monotonically_increasing_id())
    else:
        raise ValueError(f"{path} is neither an array of pairs nor an object with pairs")
    names = [c.split(" ")[0] for c in schemas.MANIFEST.split(", ")]
    return rows.select("row", *[(F.col(n) if n in rows.columns else F.lit(None)).cast("string").alias(n) for n in names])


def manifest_id(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Gold fields (path, own_pair_id, row, field_id, expected) of all annotations of a folder, with legacy labels renamed."""
    raw = spark.read.schema(schemas.ANNOTATION).json(f"{folder}/*.json", multiLine=True).withColumn("path", F.input_file_name())
    each = raw.select("path", F.col("pair_id").alias("own_pair_id"), F.posexplode("fields").alias("row", "f"))
    return each.select("path", "own_pair_id", "row", "f.field_id", coerced(F.col("f.expected")).alias("expected"), "f.optional_notes")


def resolved(ref: Column, root: str) -> Column:
    """A path, against the root unless it is absolute."""
    return F.when(ref.startswith("/"), ref).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), ref))


def annotation_path(pairs: DataFrame, root: str) -> DataFrame:
    """The explicit annotation of each pair, and only without one that named after it."""
    implied = F.concat(F.lit("annotations/"), F.col("pair_id"), F.lit(".json"))
    return pairs.withColumn("annotation", resolved(F.coalesce("annotation_path", implied), root))


def upload_name(name: str, size: int, suffixes: tuple[str, ...] = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff"), most: int = 50 << 20) -> str:
    """A safe file name; raises where the suffix, or the size, is not accepted."""
    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", name.replace("\\", "/").rsplit("/", 1)[-1]).lstrip(".") or "upload"
    if not safe.lower().endswith(suffixes):
        raise ValueError(f"unsupported file type: {safe}")
    if not 0 < size <= most:
        raise ValueError("empty file" if size <= 0 else f"file exceeds {most} bytes")
    return safe


def latest_report(reports: DataFrame) -> DataFrame:
    """Of (path, modificationTime) the newest."""
    return reports.agg(F.max_by("path", "modificationTime").alias("path"))


def index(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index of a folder's manifests, as its file has it; none where there is no file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/index.json")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.json(place.toString(), multiLine=True)


def with_annotations(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Pairs with their gold fields; a pair without an annotation keeps one row, whose ``failed`` says so."""
    joined = pairs.join(fields.withColumn("found", F.lit(True)), "pair_id", "left")
    return joined.withColumn("failed", F.col("found").isNull()).drop("found")

"""Stand-ins for scanned drawings, made of the given tables: lines, revisions, boxes, fields and gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import geometry
from palimpsest.functions.lines import normalized, stripped

LINES_PER_PAGE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan of few files would leave most of them idle; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def page_of(ln: Column) -> Column:
    return (F.floor(ln / LINES_PER_PAGE) + 1).cast("int")


def lines(documents: DataFrame) -> DataFrame:
    """(pair_id, ord, page, text) of all lines that are not blank, whole."""
    each = spread(documents.select("doc_id", "text")).select(F.col("doc_id").alias("pair_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ord", "text"))
    return each.filter(stripped(F.col("text")) != "").select("pair_id", F.col("ord").cast("long").alias("ord"), page_of(F.col("ord")).alias("page"), "text")


def revised(source: DataFrame) -> DataFrame:
    """A later revision: of ten lines one goes, one gains a suffix, one has misread letters, and one brings a new line."""
    k = F.pmod(F.col("pair_id") * 31 + F.col("ord") * 17, F.lit(10))
    text = F.when(k == 1, F.concat("text", F.lit(" REV B"))).when(k == 2, F.replace("text", F.lit("e"), F.lit("3"))).otherwise(F.col("text"))
    same = F.struct("ord", "page", text.alias("text"))
    new = F.struct((F.col("ord") + 1_000_000).alias("ord"), "page", F.concat(F.lit("ADDED "), F.col("ord").cast("string")).alias("text"))
    out = F.when(k == 0, F.array().cast("array<struct<ord:bigint,page:int,text:string>>")).when(k == 3, F.array(same, new)).otherwise(F.array(same))
    return source.select("pair_id", F.explode(out).alias("r")).select("pair_id", "r.*")


def with_normalized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("normalized", normalized(F.col("text")))


def fields(rows: DataFrame, side: str) -> DataFrame:
    """Unlabelled fields, one a line, with ids that follow from their place."""
    value = normalized(F.col("text"))
    return rows.select(
        "pair_id", "ord", F.concat_ws(":", F.lit(side), F.col("pair_id").cast("string"), F.col("ord").cast("string")).alias("field_id"), F.lit("ocr_region").alias("field_type"),
        F.lit("").alias("label"), F.col("text").alias("value"), F.lit("").alias("normalized_label"), value.alias("normalized_value"), F.col("page").alias("page_number"),
    )


def boxes(embeddings: DataFrame) -> DataFrame:
    """(page, id, bbox): a box at the first two components of each vector, on the page of its label."""
    x, y = F.col("embedding")[0].cast("double") * 100 + 500, F.col("embedding")[1].cast("double") * 100 + 500
    return embeddings.select(F.col("label").alias("page"), F.col("vec_id").alias("id"), geometry.box(x, y, x + 8.0, y + 4.0).alias("bbox"))


def gold(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Gold labels from quality and toxicity, and results from length: fields of 20 documents make a comparison."""
    expected = F.when(F.col("toxic") == 1, "changed").when(F.col("quality") == 0, "missing").when(F.col("doc_id") % 7 == 0, "extra").otherwise("matched")
    n = F.col("n_chars")
    kind = (
        F.when(n % 11 == 0, None).when(n % 7 == 0, "uncertain").when(n < 200, "missing_in_target").when(n % 5 == 0, "changed_value").when(n % 13 == 0, "extra_in_target").when(n % 3 == 0, "partial_match").otherwise("exact_match")
    )
    joined = labels.join(documents.select("doc_id", "n_chars"), "doc_id")
    in_source, in_target = kind.isNotNull() & (kind != "extra_in_target"), kind.isNotNull() & (kind != "missing_in_target")
    confidence = lambda m: (F.pmod(n, F.lit(m)) / m).cast("double")
    return joined.select(
        F.floor(F.col("doc_id") / 20).cast("long").alias("pair_id"), F.col("doc_id").alias("field_id"), expected.alias("expected"), kind.alias("match_type"),
        (in_source | (n % 2 == 0)).alias("in_source"), (in_target | (n % 4 == 0)).alias("in_target"),
        F.when(in_source, confidence(97)).alias("s_confidence"), F.when(in_target, confidence(89)).alias("t_confidence"),
    )


def sheets(part: DataFrame) -> DataFrame:
    """(pair_id, ord, label, value): a sheet of six short fields for each part, five of them labelled."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rows = [
        ("Part Name", F.col("p_name")),
        ("Brand", F.col("p_brand")),
        ("Type", F.col("p_type")),
        ("Size", F.concat(size, F.lit(" x "), (F.col("p_size") + 3).cast("string"))),
        ("", F.concat(F.lit("price "), (key % 100).cast("string"), F.lit("."), size)),
        ("Issued", F.concat(F.lit("2024-"), two(key % 12 + 1), F.lit("-"), two(key % 28 + 1))),
    ]
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(rows)])
    return part.select(key.cast("long").alias("pair_id"), F.explode(each).alias("f")).select("pair_id", "f.*")


def revised_sheets(source: DataFrame) -> DataFrame:
    """A later revision: of ten fields one goes, one gains a suffix, one is misread, one brings a note, one is renamed, one is reversed."""
    k = F.pmod(F.col("pair_id") * 7 + F.col("ord") * 3, F.lit(10))
    value = F.when(k == 1, F.concat("value", F.lit(" REV B"))).when(k == 2, F.replace("value", F.lit("e"), F.lit("3"))).when(k == 5, F.reverse("value")).otherwise(F.col("value"))
    label = F.when(k == 4, F.concat("label", F.lit(" no"))).otherwise(F.col("label"))
    same = F.struct("ord", label.alias("label"), value.alias("value"))
    note = F.struct((F.col("ord") + 100).alias("ord"), F.lit("Note").alias("label"), F.concat(F.lit("added "), F.col("ord").cast("string")).alias("value"))
    out = F.when(k == 0, F.array().cast("array<struct<ord:bigint,label:string,value:string>>")).when(k == 3, F.array(same, note)).otherwise(F.array(same))
    return source.select("pair_id", F.explode(out).alias("r")).select("pair_id", "r.*")


def sheet_fields(rows: DataFrame, side: str) -> DataFrame:
    """The fields of sheets, all on one page; part names count as titles."""
    return rows.select(
        "pair_id", "ord", F.concat_ws(":", F.lit(side), F.col("pair_id").cast("string"), F.col("ord").cast("string")).alias("field_id"),
        F.when(F.col("ord") == 0, "title_block").otherwise("ocr_region").alias("field_type"), "label", "value",
        normalized(F.col("label")).alias("normalized_label"), normalized(F.col("value")).alias("normalized_value"), F.lit(1).alias("page_number"),
    )

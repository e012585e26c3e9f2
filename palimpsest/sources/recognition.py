"""Recognised text: word rows to lines, document trees to regions, and a registry of providers.

Rendering and recognition themselves are outside; providers turn rows that they left into the
common tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.functions import geometry
from palimpsest.functions.arrays import let, running_sums


class UnsupportedProvider(ValueError):
    """No provider has this name."""


class ProviderNotAvailable(NotImplementedError):
    """The provider needs a service that is not part of this library."""


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")) -> DataFrame:
    """Path, length, time and content of scans below a folder, by suffix in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.substring_index("path", ".", -1))
    return found.filter(suffix.isin(*suffixes)).withColumn("is_pdf", suffix == "pdf")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Document trees from JSON, one a file."""
    return spark.read.schema(schemas.DOCUMENT).json(path, multiLine=True)


def lines_from_words(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines from word rows (text, confidence, bbox): joined in order, mean confidence, and the box around all."""
    word = F.col("bbox")
    kept = words.filter(F.trim("text") != "").withColumn("_unit", geometry.confidence(F.col("confidence")))
    grouped = kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), "text"))).alias("words"), F.avg("_unit").alias("confidence"),
        F.min(word["x1"]).alias("x1"), F.min(word["y1"]).alias("y1"), F.max(word["x2"]).alias("x2"), F.max(word["y2"]).alias("y2"),
    )
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    return grouped.select(*keys, text.alias("text"), F.bround("confidence", 6).alias("confidence"), geometry.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("bbox"))


def word_level(rows: DataFrame, level: int = 5) -> DataFrame:
    """Rows of words alone, with confidences of 0 to 100 brought to 0 to 1 and negative ones to 0."""
    conf = F.greatest(F.col("conf").cast("double"), F.lit(0.0)) / 100
    return rows.filter((F.col("level") == level) & (F.trim("text") != "")).withColumn("confidence", conf)


def token_boxes(line: Column, box: Column) -> Column:
    """Array of (text, x1, x2) of a line's words, its width shared out by their lengths; split once a line, and not once a word."""

    def shared(words: Column) -> Column:
        total = F.greatest(F.char_length(F.array_join(words, "")), F.lit(1))
        ends = running_sums(F.transform(words, F.char_length))
        return let(F.struct(box["x1"].alias("x1"), (geometry.width(box) / total).alias("unit")), lambda at: F.zip_with(words, ends, lambda w, end: placed(at, w, end)))

    def placed(at: Column, w: Column, end: Column) -> Column:
        return F.struct(w.alias("text"), (at["x1"] + (end - F.char_length(w)) * at["unit"]).alias("x1"), (at["x1"] + end * at["unit"]).alias("x2"))

    return let(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""), shared)


def line_id(page: Column, number: Column) -> Column:
    """The id of a line: its page, and its place there from 0."""
    return F.concat(F.lit("p"), page.cast("string"), F.lit("-l"), number.cast("string"))


#: Confidence of words that come without one, and of the words of a line that comes without words (fixed values).
WORD_CONFIDENCE, LINE_CONFIDENCE = 0.95, 0.9
#: The top share of the page that a line without a box takes (fixed value).
DEFAULT_SHARE = 0.15


def result_lines(rows: DataFrame) -> DataFrame:
    """Lines of recognition results (document_id, page_number, number, text, bbox, words, width, height).

    Words (text, bbox), if there are any, make the line; else its text does, along its box or the
    top of the page. Blank words and lines go, lines keep the number that they had.
    """
    word = lambda w: F.struct(F.trim(w["text"]).alias("text"), F.lit(WORD_CONFIDENCE).alias("confidence"), w["bbox"].alias("bbox"))
    named = F.filter(F.transform(F.coalesce("words", F.array()), word), lambda w: w["text"] != "")
    zero = F.lit(0.0)
    own = F.coalesce("bbox", geometry.from_xywh(zero, zero, F.col("width"), F.greatest(F.col("height") * DEFAULT_SHARE, F.lit(1.0))))
    along = F.transform(
        token_boxes(F.trim(F.coalesce("text", F.lit(""))), own),
        lambda t: F.struct(t["text"].alias("text"), F.lit(LINE_CONFIDENCE).alias("confidence"), geometry.box(t["x1"], own["y1"], t["x2"], own["y2"]).alias("bbox")),
    )
    tokens = F.when(F.size(F.coalesce("words", F.array())) > 0, named).otherwise(along)
    made = rows.select("document_id", "page_number", "number", line_id(F.col("page_number"), F.col("number")).alias("line_id"), tokens.alias("tokens")).filter(F.size("tokens") > 0)
    edge = lambda pick, name: pick(F.transform("tokens", lambda t: t["bbox"][name]))
    around = geometry.box(edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2"))
    mean = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size("tokens")
    return made.withColumns({"text": F.array_join(F.transform("tokens", lambda t: t["text"]), " "), "confidence": F.bround(mean, 6), "bbox": around})


def embedded_first(embedded: DataFrame, recognised: DataFrame) -> DataFrame:
    """Lines (document_id, ...) embedded in a document; those recognised only for documents without any."""
    return embedded.unionByName(recognised.join(embedded.select("document_id").distinct(), "document_id", "left_anti"))


def span_text(spans: Column) -> Column:
    """The texts of spans that are not empty, with spaces between and none at the ends."""
    return F.trim(F.array_join(F.filter(spans, lambda s: s != ""), " "))


def lines_from_spans(lines: DataFrame) -> DataFrame:
    """Lines (document_id, page_number, block, line, spans) from the spans (text, bbox) of a text layer; blank spans and lines go."""
    kept = F.filter("spans", lambda s: F.trim(s["text"]) != "")
    edge = lambda pick, name: pick(F.transform("kept", lambda s: s["bbox"][name]))
    whole = lines.withColumn("kept", kept).filter(F.size("kept") > 0)
    around = geometry.box(edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2"))
    return whole.select("document_id", "page_number", "block", "line", span_text(F.transform("kept", lambda s: F.trim(s["text"]))).alias("text"), F.lit(1.0).alias("confidence"), around.alias("bbox"))


def of_pages(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions on the given pages (document_id, page_number); a page without any has no rows."""
    return regions.join(pages.select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_semi")


def regions(docs: DataFrame) -> DataFrame:
    """One row a line, or a token where a page has no lines; blank ones go."""
    page = docs.select("document_id", F.explode("pages").alias("page"))
    line = lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox"))
    units = F.when(F.size("page.lines") > 0, F.transform("page.lines", line)).otherwise(F.transform("page.tokens", line))
    each = page.select("document_id", F.col("page.page_number").alias("page_number"), F.posexplode(units).alias("ord", "unit"))
    return each.filter(F.trim("unit.text") != "").select("document_id", "page_number", "ord", "unit.*")


def region_fields(rows: DataFrame) -> DataFrame:
    """One unlabelled field a region; the id follows from its place."""
    from palimpsest.functions.normalize import normalize_value

    return rows.select(
        F.concat_ws(":", "document_id", F.col("page_number").cast("string"), F.col("ord").cast("string")).alias("field_id"), F.lit("ocr_region").alias("field_type"), F.lit("").alias("label"),
        F.col("text").alias("value"), F.col("text").alias("raw_text"), F.lit("").alias("normalized_label"), normalize_value(F.col("text")).alias("normalized_value"), "page_number", "bbox", "confidence",
    )


def empty(spark: SparkSession, path: str) -> DataFrame:
    """A provider that recognises nothing."""
    return spark.createDataFrame([], schemas.DOCUMENT)


def _cloud(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def refuse(spark: SparkSession, path: str) -> DataFrame:
        raise ProviderNotAvailable(f"{name} needs a remote service")

    return refuse


#: Providers by name, with aliases.
PROVIDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"json": documents, "tree": documents, "stub": empty, "none": empty, "azure": _cloud("azure"), "google_vision": _cloud("google_vision"), "google": _cloud("google_vision")}


def provider(name: str) -> Callable[[SparkSession, str], DataFrame]:
    key = name.strip().lower().replace("-", "_")
    if key not in PROVIDERS:
        raise UnsupportedProvider(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[key]

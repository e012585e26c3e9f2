"""Labelled fields from text lines, by an ordered table of rules applied in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions import normalize


@dataclass(frozen=True)
class Rule:
    """A pattern over a whole line; groups are numbered, 0 for none, and a fixed label may stand in for one.

    With ``every`` the pattern is sought anywhere, and each match is a field.
    """

    rule_id: str
    field_type: str
    weight: float
    pattern: str
    label: int = 1
    value: int = 2
    fixed_label: str | None = None
    every: bool = False


def _labelled(rule_id: str, field_type: str, weight: float, names: str, tail: str = "") -> Rule:
    return Rule(rule_id, field_type, weight, rf"^\s*({names}){tail}\s*[:\-]\s*(.+?)\s*$")


#: The rules in order of precedence (fixed values).
RULES: tuple[Rule, ...] = (
    _labelled("tb_drawn_checked", "title_block.signature", 0.94, r"(?:DRAWN|CHECKED|REVIEWED|DESIGNED|APPROVED)\s*BY"),
    _labelled("tb_project_job", "title_block.project", 0.93, r"PROJECT|JOB(?:\s*NO\.?)?|CONTRACT(?:\s*NO\.?)?|CLIENT|OWNER|ENGINEER"),
    _labelled("tb_date_sheet", "title_block.sheet_meta", 0.93, r"DATE|SHEET(?:\s*(?:NO\.?|NUMBER|#))?|SHEETS?"),
    _labelled("tb_scale", "title_block.scale", 0.95, "SCALE"),
    _labelled("tb_title", "title_block.title", 0.92, r"DRAWING\s*TITLE|TITLE"),
    _labelled("dwg_number", "drawing_id.dwg_no", 0.94, "DWG|DRAWING", r"(?:\s*(?:NO\.?|NUMBER|#))?"),
    _labelled("sheet_id", "drawing_id.sheet", 0.93, "SHEET", r"\s*(?:ID|NO\.?|NUMBER|#)?"),
    _labelled("plan_id", "drawing_id.plan", 0.88, r"PLAN|KEY\s*PLAN"),
    Rule("revision_standalone", "revision", 0.91, r"^\s*(?:REV(?:ISION)?|R\.?)\s*[.:#\-]?\s*([A-Za-z0-9]+(?:\.[0-9]+)?)\s*$", 0, 1, "REV"),
    Rule("note_header", "note.header", 0.9, r"^\s*((?:GENERAL\s+)?NOTES?|NOTES?\s*CONT\.?D)\s*[:\-]?\s*(.*)\s*$"),
    Rule("note_numbered", "note.bullet", 0.82, r"^\s*(\d{1,2}[.)])\s+(.{3,})\s*$"),
    Rule("elev_line", "dimension.elevation", 0.9, r"^\s*(EL\.?|ELEV\.?|ELEVATION)\s*[:\-]?\s*([+\-]?[\d.,'′″”“\s\"/\-]+)\s*$"),
    Rule("dim_imperial_run", "dimension.imperial", 0.85, r"^\s*(\d{1,3}\s*['′]?\s*[-–—]\s*\d{1,3}\s*[\"″'])\s*$", 0, 1, ""),
    Rule("generic_kv", "generic.label_value", 0.72, r"^\s*([A-Z][A-Z0-9 /&'.]{1,40}?)\s*[:\-]\s+(.{2,})\s*$"),
)

Extractor = Callable[[Column], Column]
_MATCH = "array<struct<rule_ord:int,rule_id:string,field_type:string,weight:double,label:string,value:string,raw_text:string>>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extractor(rule: Rule, number: int) -> Extractor:
    """A column of matches of one rule over a column of lines."""
    pattern = "(?iU)" + rule.pattern

    def one(line: Column) -> Column:
        pick = lambda text, group: _strip(F.regexp_extract(text, pattern, group))
        label = lambda text: F.lit(rule.fixed_label) if rule.fixed_label is not None else pick(text, rule.label)
        row = lambda text: F.struct(
            F.lit(number).alias("rule_ord"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.field_type).alias("field_type"), F.lit(rule.weight).alias("weight"),
            label(text).alias("label"), pick(text, rule.value).alias("value"), pick(text, 0).alias("raw_text"),
        )
        if rule.every:
            return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), row).cast(_MATCH)
        return F.when(line.rlike(pattern), F.array(row(line))).otherwise(F.array()).cast(_MATCH)

    return one


DEFAULT_EXTRACTORS: tuple[Extractor, ...] = tuple(extractor(r, i) for i, r in enumerate(RULES))


def line_confidence(lines: Column, tokens_mean: Column) -> Column:
    """Of a line, else the mean of its tokens, else 0.85."""
    return F.coalesce(F.when(lines > 0, lines), F.when(tokens_mean > 0, tokens_mean), F.lit(0.85))


def extract_matches(lines: DataFrame, extractors: tuple[Extractor, ...] = DEFAULT_EXTRACTORS) -> DataFrame:
    """A row for each match of each rule, from lines with a text and a confidence; raw labels and values."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.when(text != "", F.concat(*[e(text) for e in extractors])).otherwise(F.array().cast(_MATCH))
    each = lines.withColumn("match", F.explode(found))
    names = ["rule_ord", "rule_id", "field_type", "weight", "label", "value", "raw_text"]
    return each.select(*lines.columns, *[F.col(f"match.{n}").alias(n) for n in names])


def combined_confidence(line: Column, weight: Column) -> Column:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.bround(unit(F.when(line > 0, line).otherwise(0.85)) * unit(weight), 4)


def extract_fields(lines: DataFrame, keys: list[str], extractors: tuple[Extractor, ...] = DEFAULT_EXTRACTORS, dedupe: bool = True) -> DataFrame:
    """Fields with normalised labels and values and an id made of their place; of equal ones of a line the most confident stays."""
    found = extract_matches(lines, extractors).withColumns(
        {"normalized_label": normalize.normalize_label(F.col("label")), "normalized_value": normalize.normalize_value(F.col("value")), "field_confidence": combined_confidence(F.col("confidence"), F.col("weight"))}
    )
    if dedupe:
        same = W.partitionBy(*keys, "normalized_label", "normalized_value").orderBy(F.desc("field_confidence"), "rule_ord")
        found = found.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    return found.withColumn("field_id", F.concat_ws(":", "rule_id", *[F.col(k).cast("string") for k in keys]))

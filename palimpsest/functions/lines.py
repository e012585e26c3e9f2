"""Noise, category and risk of text lines; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that extraction leaves where it fails (fixed values).
PRIVATE_USE, REPLACEMENT = r"[\x{E000}-\x{F8FF}]", "\ufffd"
_FEET, _INCH, _DASH = "['’′]", "[\"”″]", "[-–—]"
#: Short drawing tokens that never count as noise (fixed values).
MEANINGFUL = (
    r"[a-z]\d{0,3}",
    rf"\d{{1,2}}\s*{_FEET}\s*{_DASH}?\s*\d{{1,2}}\s*['’′\"”″]?",
    rf"\d+\s*{_FEET}\s*\d+\s*['’′\"”″]?",
    r"\d+\s*['’′" + "\"”″]",
    r"\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{2,4}",
    r"\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?",
    r"[\d.\s'\"°\-–—/]{2,}",
)
#: Categories of change in order of precedence (fixed values). ``el.`` and ``issue #`` stand apart from the words
#: beside them: a bound after a mark asks for a word character next, which the SQL of plans/oracle.py has to spell out.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "dimension": (
        rf"\d+\s*{_FEET}",
        rf"\d+\s*{_INCH}",
        r"\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?",
        r"\b\d+(?:\.\d+)?\s*(?:mm|cm|m|ft|in|inch|inches|deg|degrees|dia|diameter|radius)\b",
        r"\b(?:elevation|slope|grade)\b.*\d",
        r"\bel\.\b.*\d",
        r"^\s*[\d.\s'\"°\-–—/]{2,}\s*$",
    ),
    "date": (
        r"\b\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{2,4}\b",
        r"\b\d{4}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{1,2}\b",
        r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2}(?:,?\s*\d{4})?\b",
    ),
    "revision_status": (
        r"\b(?:rev|revision|revisions|status|ifc|fcd|afc|for\s+construction|as[\s\-]+built|issued|construction\s+admin)\b",
        r"\bissue\s*#\b",
        r"\brev\s*[.:]?\s*[a-z0-9]{1,6}\b",
    ),
    "identifier_code": (
        r"\b[a-z]{2,12}[-_/]\d{2,8}\b",
        r"\b[a-z]{2,12}\s*#\s*\d+\b",
        r"\b(?:dwg|drawing|sheet|sht|detail|spec)\s*[#:]?\s*[\w.\-]+\b",
        r"\b\d{3,}[-_]\d{2,}\b",
    ),
}
GENERIC = "generic_text"
CATEGORY_ORDER = (*CATEGORIES, GENERIC)
#: Base risk of each category (fixed values).
BASE_RISK = {"dimension": 78, "date": 82, "revision_status": 70, "identifier_code": 66, GENERIC: 36}


def normalized(text: Column) -> Column:
    """Lower case, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def symbol_ratio(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n == 0, 1.0).otherwise(count(text, r"(?U)[^\p{L}\p{N}\s\"'°.\-–—/\\]") / n)


def meaningful(text: Column) -> Column:
    pattern = "(?iU)^(?:" + "|".join(MEANINGFUL) + ")$"
    return text.rlike(pattern) | ((F.char_length(text) <= 4) & text.rlike("(?i)[a-z0-9]"))


def noise_line(text: Column, strictness: float) -> Column:
    """True for lines that look like extraction garbage."""
    t = stripped(text)
    n = F.char_length(t)
    compact = F.replace(t, F.lit(" "))
    size = F.char_length(compact)
    # A character with four fifths of all places, or more, has three together somewhere, which is
    # cheap to see; and it stands in the middle of all characters, sorted.
    middle = F.get(F.array_sort(F.split(compact, "")), (size / 2).cast("int"))
    share = (size - F.char_length(F.replace(compact, middle))) / size
    return (
        F.when(n == 0, True)
        .when(meaningful(t), False)
        .when(t.contains(REPLACEMENT), True)
        .when((n >= 3) & (count(t, PRIVATE_USE) / n >= 0.2 + 0.5 * strictness), True)
        .when((n >= 5) & (count(t, r"[\p{L}\p{N}]") / n < 0.12 + 0.48 * strictness), True)
        .when((n >= 4) & (symbol_ratio(t) > 0.55 + 0.35 * strictness), True)
        .when((size >= 6) & compact.rlike(r"(?s)(.)\1\1") & (share >= 0.88 - 0.08 * strictness), True)
        .otherwise(False)
    )


def change_category(source: Column, target: Column) -> Column:
    blob = stripped(F.concat_ws(" ", source, target))
    out = F.lit(GENERIC)
    for name, patterns in reversed(CATEGORIES.items()):
        out = F.when(blob.rlike("(?iU)" + "|".join(patterns)), name).otherwise(out)
    return F.when(blob == "", GENERIC).otherwise(out)


def digit_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0))


def change_risk(category: Column, source: Column, target: Column, score: Column, threshold: float) -> Column:
    """0 to 100; score is null where there is no pair."""
    base = F.lit(0)
    for name, value in BASE_RISK.items():
        base = F.when(category == name, value).otherwise(base)
    base = base + F.when(digit_groups(source) != digit_groups(target), 14).otherwise(0)
    gap = F.least(F.lit(18.0), F.greatest(F.lit(0.0), threshold - score) * 0.65)
    base = base + F.coalesce(F.floor(gap), F.lit(0))
    short = (F.char_length(stripped(source)) <= 2) | (F.char_length(stripped(target)) <= 2)
    return F.least(F.lit(100), F.when(short, F.greatest(base - 8, F.lit(0))).otherwise(base)).cast("int")


def one_sided_risk(category: Column, source: Column, target: Column, threshold: float) -> Column:
    risk = change_risk(category, source, target, F.lit(None).cast("double"), threshold)
    return F.least(F.lit(100), risk + F.when(category.isin("dimension", "date", "revision_status"), 6).otherwise(0)).cast("int")


def noise_likelihood(text: Column) -> Column:
    """0 to 100: how likely a line is extraction garbage."""
    t = stripped(text)
    n = F.greatest(F.char_length(t), F.lit(1))
    points = lambda test, value: F.when(test, value).otherwise(0)
    compact = F.regexp_replace(t, r"(?U)\s+", "")
    total = (
        points(t.contains(REPLACEMENT), 45)
        + F.when(n >= 2, F.floor(F.least(F.lit(40.0), count(t, PRIVATE_USE) / n * 120))).otherwise(0)
        + points((n >= 4) & (count(t, r"[\p{L}\p{N}]") / n < 0.35), 28)
        + points((n >= 3) & (symbol_ratio(t) > 0.45), 22)
        + points((F.char_length(compact) >= 5) & (F.size(F.array_distinct(F.split(compact, ""))) <= 2), 25)
        + points(t.rlike(r"(?U)^[\W_]+$"), 50)
    )
    return F.when(t == "", 0).otherwise(F.least(F.lit(100), total)).cast("int")


def snippet(text: Column, most: int = 72) -> Column:
    s = stripped(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("...")))


def decimals(number: Column, places: int) -> Column:
    """A number with fixed places, ties to the even digit; null for null."""
    return F.when(number.isNotNull(), F.format_string(f"%.{places}f", F.bround(number.cast("double"), places)))


def preview(text: Column, most: int = 80) -> Column:
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", None).when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def is_vertical(degrees: Column, tolerance: float = 15.0) -> Column:
    a = F.pmod(degrees, F.lit(360.0))
    a = F.when(a > 180, a - 360).otherwise(a)
    return F.least(F.abs(a - 90), F.abs(a + 90)) <= tolerance


def orientation(dx: Column, dy: Column) -> Column:
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.degrees(F.atan2(dy, dx)))

"""Personal data by weak supervision, in DataFrame operations only.

Base patterns and looser candidate patterns mark spans. Labelers vote on each: strict format,
gazetteer, context words before, contrary context words before, and plausible digits. Votes
and features of all spans of the corpus are counted by pattern of votes, a table whose size the
numbers of kinds, votes and features bound. Over those counts expectation-maximisation
estimates how reliable each labeler is and how likely each pattern is personal data; its
posteriors, as soft labels, train a naive Bayes classifier of spans over kind, shape and
context. Classifier weights return to Spark as CASE expressions. Candidates that reach
``ACCEPT`` and overlap no base span are added; base spans always stay.

Places come from the pieces between matches: ``split`` and ``regexp_extract_all`` use the same
pattern, so running lengths of pieces and matches give code points. Patterns are possessive,
so no text makes them backtrack far or recurse.

Cases: null and empty texts have no spans; spans of different kinds may overlap; repeated rows
are scanned alike; a corpus without candidates adds none; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.arrays import let, running_sums
from palimpsest.llm.shared import written

#: Base patterns, made possessive (fixed values).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates (fixed values).
LOOSE = {
    "masked_email": r"(?i)(?<![a-z0-9])[a-z0-9._+-]{2,40}+[\x20]?[(\[]?[\x20]?+(?:at|@)[\x20]?+[)\]]?[\x20]?[a-z0-9-]{2,40}+[\x20]?[(\[][\x20]?+dot[\x20]?+[)\]][\x20]?[a-z]{2,10}+",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "titled_name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?[\x20]\p{Lu}\p{Ll}{1,20}(?:[\x20]\p{Lu}\p{Ll}{1,20})?",
}
KINDS = [*BASE, *LOOSE]
#: Cheap tests that a text must pass before a pattern is applied (fixed values).
GUARD = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
    "masked_email": r"(?i)[(\[][\x20]?dot[\x20]?[)\]]", "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]{4}", "local_phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "titled_name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?[\x20]\p{Lu}",
}
#: Words before a span that speak for it, and against it (fixed values).
CUES = r"(?i)(?:e-?mail|mail|phone|tel|mobile|call|fax|contact|card|iban|account|ssn|social|name|address|signed|born|konto|telefon|carte|tarjeta|nom|nombre|ip)[^\p{L}]{0,3}(?:\p{L}{1,10}[^\p{L}]{1,3}){0,2}$"
CONTRARY = r"(?i)(?:version|release|isbn|issn|page|fig|figure|section|chapter|part|order|item|serial|model|table|no)[^\p{L}]{0,3}$"
#: Frequent given names and mail hosts (fixed values).
GAZETTEER = r"(?i)(?<!\p{L})(?:james|mary|john|anna|peter|maria|jose|jean|pierre|hans|paul|laura|david|sarah|michael|thomas|claire|sofia|juan|carlos|gmail|yahoo|outlook|hotmail|gmx|web)(?!\p{L})"
LABELERS = ("format", "gazetteer", "cue", "contrary", "digits")
FEATURES = ("kind", "size", "digit_share", "upper", "cue", "contrary")
ACCEPT, ROUNDS, SMOOTH, CONTEXT = 0.9, 25, 1.0, 40


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (start, end, span, before) of a pattern's matches, in code points; before is what stands between it and the match before."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def one(x: Column, end: Column) -> Column:
        return F.struct((end - F.char_length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("span"), F.right(x["g"], F.lit(CONTEXT)).alias("before"))

    def placed(found: Column) -> Column:
        return F.zip_with(found, running_sums(F.transform(found, lambda x: F.char_length(x["g"]) + F.char_length(x["m"]))), one)

    none = F.array().cast("array<struct<start:int,end:int,span:string,before:string>>")
    return F.when(text.rlike(GUARD[kind]), let(F.filter(pairs, lambda x: x["m"].isNotNull()), placed)).otherwise(none)


def luhn(digits: Column) -> Column:
    """The check digit rule over a string of digits."""
    n = F.char_length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when((n - 1 - i) % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]+", "")


def passes(kind: str, span: Column) -> Column:
    """The tests that a base match must pass."""
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(span, r"\."), lambda p: (F.char_length(short(p)) <= 3) & (F.right(short(p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.char_length(_digits(span)).between(12, 19) & luhn(_digits(span))
    if kind == "phone":
        return F.char_length(_digits(span)).between(9, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda x: passes(kind, x["span"])


def _is(number: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == number


def _votes(kind: str, span: Column, before: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1, 0 or -1."""
    strict = {
        "masked_email": span.rlike(r"(?i)[(\[]\s?at\s?[)\]]"),
        "national_id": ~span.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "iban": F.char_length(F.replace(span, F.lit(" "))).between(15, 34),
        "local_phone": span.rlike(r"^\("),
        "titled_name": span.rlike(r"\.\x20"),
    }.get(kind, F.lit(True))
    n = F.char_length(_digits(span))
    plausible = {"national_id": n == 9, "local_phone": n == 10, "iban": n >= 10}.get(kind, F.lit(None).cast("boolean"))
    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "format": one(strict),
        "gazetteer": one(span.rlike(GAZETTEER)),
        "cue": one(before.rlike(CUES)),
        "contrary": -one(before.rlike(CONTRARY)),
        "digits": F.when(plausible.isNull(), 0).when(plausible, 1).otherwise(-1),
    }


def _described(kind: str, spans: Column) -> Column:
    """Spans with their kind's number, votes and shape."""

    def one(x: Column) -> Column:
        span = x["span"]
        n = F.char_length(span)
        shape = {
            "size": F.least(n / 8, F.lit(5)).cast("int"),
            "digit_share": (4 * F.char_length(_digits(span)) / n).cast("int"),
            "upper": F.when(span.rlike("[A-Z]"), 1).otherwise(0),
        }
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), *[v.cast("int").alias(k) for k, v in _votes(kind, span, x["before"]).items()], *[v.alias(k) for k, v in shape.items()]
        )

    return F.transform(spans, one)


def marked(documents: DataFrame) -> DataFrame:
    """Struct ``row``, a whole document, and its base and candidate spans with votes and shapes, sorted.

    Candidates never overlap base spans.
    """
    first = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    first = first.select("row", *[matches(text, kind, pattern).alias(kind) for kind, pattern in (BASE | LOOSE).items()])
    kept = {k: F.filter(F.col(k), _test(k)) for k in BASE}
    second = first.select("row", *LOOSE, F.array_sort(F.concat(*[_described(k, v) for k, v in kept.items()])).alias("base"))
    third = second.select("row", "base", F.array_sort(F.concat(*[_described(k, F.col(k)) for k in LOOSE])).alias("loose"))
    free = F.filter("loose", lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return third.select("row", "base", F.when(F.size("loose") > 0, free).otherwise(F.col("loose")).alias("loose"))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes, from how often each occurs; starts from the majority."""
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in patterns}
    for _ in range(ROUNDS):
        weight = [sum(n * (p if y else 1 - p) for v, n in patterns for p in [post[v]]) for y in (0, 1)]
        table = [[defaultdict(lambda: SMOOTH) for _ in LABELERS] for _ in (0, 1)]
        for v, n in patterns:
            for k, vote in enumerate(v):
                table[1][k][vote] += n * post[v]
                table[0][k][vote] += n * (1 - post[v])
        prior = (weight[1] + SMOOTH) / (sum(weight) + 2 * SMOOTH)
        for v, _ in patterns:
            log = math.log(prior / (1 - prior))
            for k, vote in enumerate(v):
                log += math.log(table[1][k][vote] / (weight[1] + 3 * SMOOTH)) - math.log(table[0][k][vote] / (weight[0] + 3 * SMOOTH))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return post


def train(rows: list[tuple[dict[str, int], tuple[int, ...], int]]) -> tuple[float, dict[str, dict[int, float]]]:
    """Intercept and log-odds of each value of each feature, from soft labels."""
    counts: dict[tuple[int, ...], int] = defaultdict(int)
    for _, votes, n in rows:
        counts[votes] += n
    post = expectation_maximisation(list(counts.items()))
    total = [SMOOTH, SMOOTH]
    table: dict[str, dict[int, list[float]]] = {f: defaultdict(lambda: [SMOOTH, SMOOTH]) for f in FEATURES}
    for features, votes, n in rows:
        for y, p in ((1, post[votes]), (0, 1 - post[votes])):
            total[y] += n * p
            for f in FEATURES:
                table[f][features[f]][y] += n * p
    weights = {f: {v: math.log(c[1] / total[1]) - math.log(c[0] / total[0]) for v, c in own.items()} for f, own in table.items()}
    return math.log(total[1] / total[0]), weights


def _score(x: Column, intercept: float, weights: dict[str, dict[int, float]]) -> Column:
    score = F.lit(intercept)
    for feature, own in weights.items():
        case = None
        for value, weight in own.items():
            case = F.when(x[feature] == value, weight) if case is None else case.when(x[feature] == value, weight)
        if case is not None:
            score = score + case.otherwise(0.0)
    return score


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _found(spans: DataFrame) -> DataFrame:
    """Of marked rows: struct ``row`` with its base spans and accepted candidates, each as an array of (start, kind, end)."""
    spans = written(spans, "spans")
    each = spans.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.*")
    keys = list(dict.fromkeys([*LABELERS, *FEATURES]))
    rows = [({f: r[f] for f in FEATURES}, tuple(r[k] for k in LABELERS), r["count"]) for r in each.groupBy(*keys).count().collect()]
    intercept, weights = train(rows) if rows else (0.0, {})
    least = math.log(ACCEPT / (1 - ACCEPT))
    short = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    added = F.filter("loose", lambda x: _score(x, intercept, weights) >= least)
    return spans.select("row", short(F.col("base")).alias("base"), short(added).alias("added"))


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, base spans and accepted candidates, each as an array of (start, kind, end)."""
    spans = marked(documents.select("doc_id", "text"))
    return _found(spans.select(F.struct("row.doc_id").alias("row"), "base", "loose")).select("row.doc_id", "base", "added")


def digest(documents: DataFrame) -> DataFrame:
    found = personal_data(documents)
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def masked(documents: DataFrame) -> DataFrame:
    """The documents with every span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced as one, named after the first. Spans stay in the row that they
    were found in, so repeated or null ids and columns of any name do no harm.
    """
    found = _found(marked(documents)).select("row", F.array_sort(F.concat("base", "added")).alias("spans"))
    names, text = F.array(*[F.lit(f"[{k}]") for k in KINDS]), F.col("row.text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        inside = x["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.get(names, x["kind"]))).alias("out"),
        )

    whole = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return found.select(*[F.when(F.size("spans") > 0, whole).otherwise(text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns])

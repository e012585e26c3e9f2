import random
from difflib import SequenceMatcher
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import geometry, normalize, similarity
from palimpsest.functions.arrays import running_sums
from palimpsest.functions import lines as L
from palimpsest.functions.similarity import common_subsequence, ratio_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randrange(20))) for _ in range(2))
        assert common_subsequence(a, b) == lcs(a, b)
    assert ratio_of("", "") == 100 and ratio_of("a", "") == 0


def set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    s, p, q = (" ".join(sorted(v)) for v in (x & y, x - y, y - x))
    if s and (not p or not q):
        return 100.0
    u, v = " ".join(filter(None, (s, p))), " ".join(filter(None, (s, q)))
    options = [ratio_of(u, v)] if not s else [200 * (len(s) + 1 + lcs(p, q)) / (len(u) + len(v))]
    return max(options + ([ratio_of(s, u), ratio_of(s, v)] if s else []))


def test_token_ratios(spark):
    r = random.Random(2)
    rows = [tuple(" ".join(r.choice(["a", "bc", "def", "ab", "é"]) for _ in range(r.randrange(6))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", similarity.token_set_ratio(F.col("a"), F.col("b")).alias("s"), similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("t")).collect()
    for x in got:
        assert x.s == pytest.approx(set_ratio(x.a, x.b)), (x.a, x.b)
        assert x.t == pytest.approx(ratio_of(" ".join(sorted(x.a.split())), " ".join(sorted(x.b.split()))))


def test_ratios_of_many_pairs_are_those_of_each():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abé漢 \0") for _ in range(r.choice([0, 1, 5, 30, 70, 200])))
    a, b = [word() for _ in range(12)], [word() for _ in range(40)]
    pairs = [(r.choice(a), r.choice(b)) for _ in range(600)]
    found = similarity.ratios(*map(list, zip(*pairs)))
    assert found == [ratio_of(x, y) for x, y in pairs]


NORMAL = [
    ("line", "  PROJECT   NAME　  ", "project name"),
    ("line", "“TRENCH” SECTION", '"trench" section'),
    ("line", "A—101", "a-101"),
    ("line", "l2o", "l2o"),
    ("value", "l2o", "120"),
    ("value", "Length 1.234,56 m", "length 1234.56 m"),
    ("value", "12o34 noted", "12034 noted"),
    ("value", "12×18 FT", "12 x 18 ft"),
    ("value", "EL. +125.5'", "el +125.5'"),
    ("value", "Elev: 3 and elev: 4", "el 3 and elev: 4"),
    ("label", "REV.", "rev"),
    ("label", "  DATE : ; ", "date"),
    ("value", "Issued Rev: B", "issued rev b"),
    ("value", "Revision 03", "rev 03"),
    ("value", "R3 ", "rev 3"),
    ("value", "S - 401", "s-401"),
    ("value", "S - 401 – B2 x", "s-401-b2 x"),
    ("value", "１２３", "123"),
    ("value", "1/4 and 1,234", "1/4 and 1234"),
    ("value", "1,234,567.5 but 12,5", "1234567.5 but 12.5"),
    ("value", "Straße 5/8 O1 ﬁn", "strasse 5/8 01 fin"),
    ("value", "6″ pipe \u200b1/4''", "6\" pipe 1/4\""),
    ("line", "a…b;;;c", "a...b;c"),
    ("line", "3=4", "3 = 4"),
]


def test_normalisation(spark):
    df = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(NORMAL)], "i int, f string, t string")
    made = {f: getattr(normalize, f"normalize_{f}")(F.col("t")) for f in ("line", "label", "value")}
    got = {r.i: r[r.f] for r in df.withColumns(made).collect()}
    assert [got[i] for i in range(len(NORMAL))] == [e for _, _, e in NORMAL]


def test_ascii_texts_stay_out_of_python(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(normalize.marks(F.lower("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_normalise_columns(spark):
    row = spark.createDataFrame([("A|B", None, "")], "a string, b string, c string").select(
        normalize.canonical_key(F.col("a"), F.lit("C|D")).alias("k"), normalize.canonical_key(F.col("a"), F.col("c")).alias("one"), normalize.normalize_value(F.col("b")).alias("n"), normalize.ocr_text(F.lit("  A \n b ")).alias("o")
    )
    assert tuple(row.first()) == ("A/B|C/D", "A/B", "", "a b")


def test_running_sums(spark):
    r = random.Random(1)
    lists = [[r.randrange(50) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 1000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select("i", running_sums(F.col("x")).alias("s")).collect()
    assert {x.i: x.s for x in got} == {i: list(accumulate(x)) for i, x in enumerate(lists)}


def test_noise_and_categories(spark):
    texts = ["E", "6\"", "0' - 6\"", "�" * 8, "|" * 14, "normal label", "", "aaaaaaaa", "x", "12x24"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.noise_line(F.col("t"), 0.92).alias("noise"), L.noise_likelihood(F.col("t")).alias("p"))
    got = {r.t: (r.noise, r.p) for r in df.collect()}
    assert [got[t][0] for t in texts] == [False, False, False, True, True, False, True, True, False, False]
    assert got["�" * 8][1] == 100 and got["normal label"][1] == 0
    pairs = [("Jan 15, 2024 note", "Feb 16, 2024 note", "date"), ("12' wide", "", "dimension"), ("REV B", "REV C", "revision_status"), ("GS-1001", "", "identifier_code"), ("plain", "text", "generic_text"), ("", "", "generic_text"), ("el.5", "", "dimension")]
    df = spark.createDataFrame(pairs, "a string, b string, c string")
    assert all(r.c == r.k for r in df.withColumn("k", L.change_category(F.col("a"), F.col("b"))).collect())
    row = spark.range(1).select(
        L.change_risk(F.lit("date"), F.lit("Jan 15"), F.lit("Feb 16"), F.lit(80.0), 91.96).alias("r"), L.one_sided_risk(F.lit("date"), F.lit("Jan 15"), F.lit(""), 91.96).alias("o"),
        L.snippet(F.lit("x" * 80)).alias("s"), L.preview(F.lit("y " * 60)).alias("p"), L.is_vertical(F.lit(-80.0)).alias("v"),
    ).first()
    assert (row.r, row.o, row.v) == (100, 94, True) and row.s == "x" * 71 + "..." and len(row.p) == 80


def test_geometry(spark):
    a, b = (geometry.box(*map(F.lit, v)) for v in ((0, 0, 10, 10), (5, 5, 15, 15)))
    row = spark.range(1).select(
        geometry.iou(a, b).alias("iou"), geometry.union(a, b).alias("u"), geometry.center_distance(a, b).alias("d"), geometry.intersects(a, geometry.box(*map(F.lit, (10, 0, 12, 5)))).alias("touch"),
        geometry.normalized(geometry.box(*map(F.lit, (10, 10, 40, 50))), F.lit(100), F.lit(100)).alias("n"), geometry.confidence(F.lit(85)).alias("c"), geometry.tiles(F.lit(3000), F.lit(1000), 1536, 0.12).alias("t"),
        geometry.rotated_bounds(a, F.lit(90.0), F.lit(20.0), F.lit(10.0)).alias("r"),
    ).first()
    assert row.iou == pytest.approx(25 / 175) and tuple(row.u) == (0, 0, 15, 15) and row.d == pytest.approx(50**0.5) and not row.touch
    assert tuple(row.n) == (0.1, 0.1, 0.4, 0.5) and row.c == 0.85
    assert [(t.row, t.col, t.x, t.width, t.height) for t in row.t] == [(0, 0, 0, 1536, 1000), (0, 1, 1352, 1536, 1000), (0, 2, 2704, 296, 1000)]
    assert [round(v, 6) for v in row.r] == [0, 10, 10, 20]


def test_sequence_matcher_is_not_the_ratio():
    """The ratio is not that of difflib, whose blocks are not the longest common subsequence."""
    a, b = "abxcd", "abcdx"
    assert ratio_of(a, b) == 80 and SequenceMatcher(None, a, b).ratio() == pytest.approx(0.8)

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.functions import geometry
from palimpsest.operators import classify, compare, evaluate, extract, spatial, textdiff, validate
from palimpsest.plans import sinks
from palimpsest.scratch import checkpointed
from palimpsest.sources import fixtures, manifests, recognition


@pytest.mark.parametrize(
    "text,expected",
    [
        ("DRAWN BY:  J.SMITH", ("title_block.signature", "tb_drawn_checked", "DRAWN BY", "J.SMITH")),
        ("SCALE:  1/8\" = 1'-0\"", ("title_block.scale", "tb_scale", "SCALE", "1/8\" = 1'-0\"")),
        ("DWG  NO. :  GS-1001-A", ("drawing_id.dwg_no", "dwg_number", "DWG", "GS-1001-A")),
        ("SHEET NO: 3 OF 12", ("drawing_id.sheet", "sheet_id", "SHEET", "3 OF 12")),
        ("REV  B", ("revision", "revision_standalone", "REV", "B")),
        ("GENERAL NOTES:", ("note.header", "note_header", "GENERAL NOTES", "")),
        ("1.  Field verify all", ("note.bullet", "note_numbered", "1.", "Field verify all")),
        ("EL. +125.5'", ("dimension.elevation", "elev_line", "EL.", "+125.5'")),
        ("SUBMITTAL:  SUB-441 REV A", ("generic.label_value", "generic_kv", "SUBMITTAL", "SUB-441 REV A")),
        ("12'-6\"", ("dimension.imperial", "dim_imperial_run", "", "12'-6\"")),
    ],
)
def test_extraction(spark, text, expected):
    df = spark.createDataFrame([(1, text, 0.88)], "id long, text string, confidence double")
    assert expected in {(r.field_type, r.rule_id, r.label, r.value) for r in extract.extract_matches(df).collect()}


def test_extraction_keeps_the_surest(spark):
    df = spark.createDataFrame([(1, "DATE: 2024-01-02", 0.88, "x"), (2, "", 0.5, "x"), (3, None, 0.5, "x")], "id long, text string, confidence double, label_x string")
    rows = extract.extract_fields(df, ["id"]).collect()
    assert len({(r.normalized_label, r.normalized_value) for r in rows}) == len(rows) and all(r.field_id.endswith(":1") for r in rows)
    own = extract.extractor(extract.Rule("num", "number", 0.5, r"\d+", 0, 0, "N", True), 99)
    assert [r.value for r in extract.extract_matches(df, (own,)).collect()] == ["2024", "01", "02"]


def test_clusters(spark):
    r = random.Random(3)
    rows = [(i, i % 2, r.random() * 20, r.random() * 20) for i in range(80)]
    boxes = spark.createDataFrame(rows, "id long, page int, x double, y double").select("id", "page", geometry.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("bbox"))
    for most in (1.5, 3.0):
        root = {i: i for i, *_ in rows}
        changed = True
        while changed:
            changed = False
            for a, p, x, y in rows:
                for b, q, u, v in rows:
                    if p == q and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= most and root[a] < root[b]:
                        root[b], changed = root[a], True
        assert {c.id: c.cluster for c in spatial.clusters(boxes, spatial.by_distance(boxes, most), cut=checkpointed).collect()} == root
    assert spatial.by_overlap(boxes, 0.0).count() == 2 * 40 * 39 // 2


def test_badges_stand_beside_their_marks(spark):
    rows = [(1, 1, i, 50.0 + i, 50.0, 60.0 + i, 60.0) for i in range(12)] + [(1, 2, i, 300.0 * i, 400.0 * i, 300.0 * i + 40, 400.0 * i + 40) for i in range(3)]
    marks = spark.createDataFrame(rows, "pair_id long, page_number int, index int, a double, b double, c double, d double").select("pair_id", "page_number", "index", geometry.box(*map(F.col, "abcd")).alias("anchor"))
    got = {(r.page_number, r["index"]): r for r in spatial.badge_places(marks, 700, 900).collect()}
    size = marks.select("page_number", "index", geometry.badge(F.col("index"), F.lit(700), F.lit(900)).alias("b")).collect()
    for r in size:
        own = got[r.page_number, r["index"]]
        assert (own.x2 - own.x1, own.y2 - own.y1) == (r.b.width, r.b.height) and 0 <= own.x1 and own.x2 <= 700 and 0 <= own.y1 and own.y2 <= 900
    apart = lambda p, q: p[2] <= q[0] or q[2] <= p[0] or p[3] <= q[1] or q[3] <= p[1]
    for page in (1, 2):
        own = [got[page, i][4:8] for i in range(12 if page == 1 else 3)]
        assert all(apart(p, q) for i, p in enumerate(own) for q in own[:i])
        boxes = [tuple(map(int, r[3:])) for r in rows if r[1] == page]
        assert all(apart(p, q) for p, (name, *_) in zip(own, ((got[page, i].placement,) for i in range(len(own)))) if name != "inside" for q in boxes)
    # On a page with room: above first, to the right where there is none above, on the left in the corner below.
    gap, (w, h) = size[0].b.gap, (size[0].b.width, size[0].b.height)
    assert got[2, 0].placement == "outside_right" and (got[2, 0].x1, got[2, 0].y1) == (40 + gap, 0)
    assert got[2, 1].placement == "outside_top" and (got[2, 1].x1, got[2, 1].y2) == (300, 400 - gap)
    assert got[2, 2].placement == "outside_top" and got[2, 2].x1 == 600


def test_no_room_for_a_badge_but_inside():
    assert spatial.place_badge((0, 0, 100, 60), 20, 10, 4, (100, 60), [], [(0, 0, 100, 60)]) == ("inside", (4, 4, 24, 14))
    # The first place inside is taken: the next step to the right.
    assert spatial.place_badge((0, 0, 100, 60), 20, 10, 4, (100, 60), [(4, 4, 24, 14)], [(0, 0, 100, 60)])[1] == (28, 4, 48, 14)
    # Above is taken: along the top edge, by steps to the right.
    name, place = spatial.place_badge((50, 50, 60, 60), 10, 10, 4, (200, 200), [(50, 36, 60, 46)], [(50, 50, 60, 60)])
    assert name == "outside_top" and place == (62, 36, 72, 46)


def test_evaluation(spark):
    updates = [("matched", "exact_match"), ("changed", "changed_value"), ("changed", "partial_match"), ("missing", "missing_in_target"), ("missing", None), ("extra", "uncertain")]
    scored = spark.createDataFrame([(1, g, k) for g, k in updates], "pair_id long, expected string, match_type string")
    matrix = {r.expected: r for r in evaluate.confusion(scored).collect()}
    assert matrix["changed"].matched == 1 and matrix["missing"]["none"] == 1 and matrix["extra"].uncertain == 1 and sum(sum(tuple(r)[1:]) for r in matrix.values()) == 6
    counted = {r.label: (r.tp, r.fp, r.fn) for r in evaluate.counts(scored).collect()}
    assert counted == {"matched": (1, 1, 0), "changed": (1, 0, 1), "missing": (1, 0, 1), "extra": (0, 0, 1)}
    assert {r.task: r.accuracy for r in evaluate.binary_tasks(scored).collect()} == {"changed_value_detection": 0.5, "missing_detection": 0.5}
    whole = evaluate.run_summary(evaluate.counts(scored)).first()
    assert whole.gold_fields == 6 and whole.field_accuracy == 0.5 and whole.macro_f1 == pytest.approx((2 / 3 * 3) / 4)
    by_pair = evaluate.run_summary(evaluate.counts(scored, "pair_id"), "pair_id").first()
    assert by_pair.pair_id == 1 and by_pair.macro_f1 == pytest.approx(whole.macro_f1)
    gold = spark.createDataFrame([(1, "a", "matched"), (1, "b", "extra"), (1, "c", "missing")], "pair_id long, field_id string, expected string")
    results = spark.createDataFrame([(1, 0, "a", "x", "exact_match"), (1, 1, "a", "y", "uncertain"), (1, 2, None, "b", "extra_in_target")], "pair_id long, result_ord long, s_field_id string, t_field_id string, match_type string")
    assert {r.field_id: r.match_type for r in evaluate.joined(gold, results).collect()} == {"a": "exact_match", "b": "extra_in_target", "c": None}
    assert [r.c for r in spark.createDataFrame([("exact_match",), ("changed",)], "l string").select(evaluate.coerced(F.col("l")).alias("c")).collect()] == ["matched", "changed"]


def lines(spark, rows):
    return fixtures.with_normalized(spark.createDataFrame(rows, "pair_id long, ord long, page int, text string"))


def test_text_difference(spark):
    a = lines(spark, [(1, 0, 1, "Issued Jan 15, 2024 note"), (1, 1, 1, "same line"), (1, 2, 1, "gone entirely 12345"), (1, 3, 1, "same line")])
    b = lines(spark, [(1, 0, 1, "Issued Feb 16, 2024 note"), (1, 1, 1, "same line"), (1, 2, 2, "brand new words")])
    a, b = textdiff.first_of_each(a), textdiff.first_of_each(b)
    rows = textdiff.difference(a, b, 0.92, cut=checkpointed)
    got = {(r.kind, r.category) for r in rows.collect()}
    assert got == {("changed", "date"), ("matched", "generic_text"), ("missing", "generic_text"), ("extra", "generic_text")}
    one = textdiff.summary(rows).first()
    assert (one.matched, one.changed, one.missing, one.extra, one.changed_date, one.high_risk) == (1, 1, 1, 1, 1, 1)
    assert [r.kind for r in textdiff.recap(rows).orderBy("rank").collect()] == ["changed", "missing", "extra"]
    assert textdiff.top_snippets(rows).count() == 3 and textdiff.noise_bullets(rows).count() == 2


def test_page_stats(spark):
    rows = [(1, 0, 1, "words"), (1, 1, 1, "Words "), (1, 2, 1, "||||||||||||||"), (1, 3, 2, "other"), (1, 4, 2, "  ")]
    df = spark.createDataFrame(rows, "pair_id long, ord long, page int, text string")
    got = {r.page: (r.raw, r.noise_dropped, r.dedupe_removed, r.kept) for r in textdiff.page_stats(df, 0.92).collect()}
    assert got == {1: (3, 1, 1, 1), 2: (1, 0, 0, 1), None: (4, 1, 1, 2)}


def test_grounding(spark):
    row = spark.range(1).select(
        validate.integers(F.lit("12 of 3.5 and 007, .5 6. a7")).alias("i"), validate.ungrounded(F.lit("3 exact match, 9 extra in target"), F.lit('{"exact_match": 3}')).alias("u"), validate.bullets(F.lit("x\n- a b\n 2) c\n--")).alias("b")
    ).first()
    assert row.i == ["12", "7", "6"] and row.u == ["9", "extra_in_target"] and row.b == ["a b", "c"]


def test_validation(spark):
    manifest = spark.createDataFrame([(0, "p", "a.pdf", "b.pdf"), (1, "p", "a.pdf", "c.pdf"), (2, "q", "a.pdf", "b.pdf")], "row long, pair_id string, drawing_a_ref string, drawing_b_ref string")
    notes = spark.createDataFrame([("p", 0, "f", "p"), ("p", 1, "f", "other")], "pair_id string, row long, field_id string, own_pair_id string")
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "path string")
    got = sorted(tuple(r) for r in validate.check_manifest(manifest, notes, files).collect())
    assert got == [("error", "annotation of p names other"), ("error", "duplicate field_id f in p"), ("error", "duplicate pair_id p at row 1"), ("error", "missing file c.pdf of p"), ("warning", "no annotation for q")]


def test_manifests(spark, tmp_path):
    pairs = [{"pair_id": "p", "drawing_a_ref": "x", "drawing_b_ref": "/y"}]
    for name, body in (("plain", pairs), ("wrapped", {"schema_version": 1, "pairs": pairs})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        row = manifests.annotation_path(manifests.manifest(spark, str(tmp_path / f"{name}.json")), "/root").first()
        assert (row.pair_id, row.annotation) == ("p", "/root/annotations/p.json")
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        manifests.manifest(spark, str(tmp_path / "bad.json"))
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "p.json").write_text(json.dumps({"pair_id": "p", "fields": [{"field_id": "f", "expected": "exact_match"}]}))
    assert [(r.field_id, r.expected) for r in manifests.annotations(spark, str(tmp_path / "notes")).collect()] == [("f", "matched")]
    assert manifests.upload_name("../we ird.PDF", 5) == "we_ird.PDF"
    for bad in (("a.exe", 5), ("a.pdf", 0), ("a.pdf", 51 << 20)):
        with pytest.raises(ValueError):
            manifests.upload_name(*bad)


def test_recognition(spark):
    box = lambda a, b: {"x1": a, "y1": 0.0, "x2": b, "y2": 1.0}
    words = spark.createDataFrame([(1, 2, "two", 90.0, box(5.0, 9.0)), (1, 1, "one", 70.0, box(0.0, 4.0)), (1, 3, " ", 0.0, box(0.0, 99.0))], f"line int, n int, text string, confidence double, bbox {schemas.BOX}")
    row = recognition.lines_from_words(words, ["line"], "n").first()
    assert (row.text, row.confidence, tuple(row.bbox)) == ("one two", 0.8, (0.0, 0.0, 9.0, 1.0))
    line = {"text": "L", "confidence": 0.9, "bbox": box(0.0, 1.0), "tokens": []}
    token = {"text": "T", "confidence": 0.5, "bbox": box(0.0, 1.0)}
    docs = spark.createDataFrame([("d", "p", "x", [{"page_number": 1, "lines": [line, {**line, "text": " "}], "tokens": [token]}, {"page_number": 2, "lines": [], "tokens": [token]}], {})], schemas.DOCUMENT)
    regions = recognition.regions(docs)
    assert sorted((r.page_number, r.text) for r in regions.collect()) == [(1, "L"), (2, "T")]
    assert {r.field_id for r in recognition.region_fields(regions).collect()} == {"d:1:0", "d:2:0"}
    assert recognition.provider("Stub")(spark, "").count() == 0
    with pytest.raises(recognition.UnsupportedProvider):
        recognition.provider("nothing")
    with pytest.raises(recognition.ProviderNotAvailable):
        recognition.provider("google-vision")(spark, "")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k long, n long, v string")
    assert {(r.k, r.match_type) for r in compare.exact_revision_diff(df, df.filter("k = 1").unionByName(spark.createDataFrame([(3, 0, "c")], df.schema)), ["k", "n"], F.col("v")).collect()} == {(1, "exact_match"), (2, "missing_in_target"), (3, "extra_in_target")}
    results = spark.createDataFrame([(1, 0, 0, "s", "t", "changed_value", 0.5, "why", "a|b", "c\nd")], "pair_id long, s_ord long, t_ord long, s_field_id string, t_field_id string, match_type string, confidence double, reason string, s_value string, t_value string")
    counted = classify.summary(results)
    flags = spark.createDataFrame([(1, "s", "changed_value", "low", "r", 0.5)], "pair_id long, field_reference string, type string, severity string, reason string, confidence double")
    report = json.loads(sinks.json_reports(results, counted, flags).first().report)
    assert report["summary"]["changed"] == 1 and len(report["sections"]["changed"]) == 1 and report["flags"][0]["severity"] == "low"
    assert sinks.markdown_rows(results).first().line == "| changed_value | a\\|b | c d | 50% | why |"
    assert sinks.executive_sentence(counted).first().sentence == "1 source fields: 1 changed"
    scored = spark.createDataFrame([("matched", "exact_match")], "expected string, match_type string")
    c = evaluate.counts(scored)
    sinks.write_evaluation(str(tmp_path / "e"), evaluate.precision_recall(c), evaluate.confusion(scored), evaluate.run_summary(c))
    assert spark.read.csv(str(tmp_path / "e" / "labels"), header=True).filter("label = 'matched'").first().f1 == "1.000000"


def test_stale_and_annotations(spark):
    jobs = spark.sql("select 1 as job_id, timestamp'2024-01-01' as modified union all select 2, timestamp'2024-01-02 12:00'")
    assert [r.job_id for r in validate.stale(jobs, F.lit("2024-01-03").cast("timestamp")).collect()] == [1]
    rows = spark.createDataFrame([(1, i, k, None, "x") for i, k in enumerate(["exact_match", "uncertain", "changed_value"])], "pair_id long, result_ord long, match_type string, s_bbox string, t_bbox string")
    assert [(r["index"], r.annotation_id, r.anchor) for r in spatial.annotations(rows).orderBy("index").collect()] == [(1, "ann-001", "x"), (2, "ann-002", "x")]

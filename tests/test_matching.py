import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import CompareConfig, checked_thresholds, patched
from palimpsest.operators import classify, compare, matching
from palimpsest.scratch import checkpointed

#: source, target, outcome, and four signals (fixed values of a recorded comparison).
RECORDED = [
    ("#12-14X1-1/4 SDS", "#12-14X1-1/4 SDS W/WASHER", "changed_value", 0.800, 0.875, 1.000, 0.845),
    ("4' - 0\"", "7' - 0\"", "changed_value", 0.857, 0.595, 1.000, 0.821),
    ("1' - 0\"", "1' - 0 1/16\"", "changed_value", 0.737, 0.702, 1.000, 0.767),
    ("W/ WASHER (FASTENER # 17A)", "W/ WASHER (FASTENER", "changed_value", 0.844, 0.875, 0.750, 0.837),
    ("06/08/2024", "08/06/2024", "changed_value", 0.800, 0.900, 1.000, 0.851),
    ("APPROVED - 09/11/2024", "APPROVED - 12/31/2024", "changed_value", 0.842, 0.588, 1.000, 0.810),
    ("APPROVED - 09/11/2024", "10/11/2024", "changed_value", 0.621, 0.510, 1.000, 0.652),
    ("W/WASHER FASTENER #17A", "W/ WASHER (FASTENER # 17A)", "partial_match", 0.917, 0.896, 0.750, 0.888),
    ("8\"", "0' - 8\"", "partial_match", 0.444, 0.750, 1.000, 0.592),
    ("6\" 6\"", "0' - 6\"", "partial_match", 0.500, 0.750, 1.000, 0.627),
    ("TO TOP AND BOTTOM OF EACH GIRT)", "TOP AND BOTTOM OF EACH GIRT) - ASSUMING VERTICAL INSTALLATION OF 2' X 4'", "partial_match", 0.583, 0.705, 0.500, 0.597),
    ("W/ WASHER (FASTENER", "(FASTENER # 17A)", "partial_match", 0.629, 0.485, 0.750, 0.615),
    ("8/15/2024 2:59:25 PM", "11/26/2024 4:09:14 PM", "partial_match", 0.634, 0.303, 1.000, 0.615),
]
FIELD = "pair_id long, ord long, page_number int, value string, label string"


def fields(spark, rows):
    from palimpsest.functions.normalize import normalize_label, normalize_value

    df = spark.createDataFrame(rows, FIELD)
    return df.withColumns({"normalized_label": normalize_label(F.col("label")), "normalized_value": normalize_value(F.col("value")), "field_id": F.concat_ws("-", F.col("pair_id").cast("string"), F.col("ord").cast("string")), "field_type": F.lit("ocr_region")})


def test_recorded_signals(spark):
    cfg = CompareConfig.service()
    source, target = (fields(spark, [(i, 0, 1, r[k], "") for i, r in enumerate(RECORDED)]) for k in (0, 1))
    got = {r.pair_id: r for r in classify.classified(matching.breakdown(source, target, cfg), cfg).collect()}
    for i, (_, _, kind, *signals) in enumerate(RECORDED):
        r = got[i]
        assert [r.value_similarity, r.token_overlap, r.regex_compatibility, r.composite] == pytest.approx(signals, abs=6e-4), RECORDED[i]
        assert r.match_type == kind
        assert kind != "changed_value" or r.confidence == 1.0


def test_blocks_score_what_pairs_do(spark, monkeypatch):
    """Signals of all pairs by the column functions; and the same whatever the size of a block."""
    from palimpsest.functions import similarity

    r = random.Random(11)
    words = ["alpha", "beta", "b2", "gamma ray", "12 x 4", "é", "-", "", "delta-7", "x"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n))).strip()
    rows = [[(p, i, g, text(6), text(3)) for p in range(4) for g in (1, 2) for i in range(7 * g, 14 * g)] for _ in range(2)]
    source, target = (fields(spark, x) for x in rows)
    cfg = CompareConfig.service()
    found = {}
    for size in (1, 3, 32):
        monkeypatch.setattr(matching, "BLOCK", size)
        found[size] = sorted(map(tuple, matching.breakdown(source, target, cfg).collect()))
    assert found[1] == found[3] == found[32]
    joined = lambda label, value: F.trim(F.concat_ws(" ", F.trim(label), F.trim(value)))
    pairs = source.alias("s").join(target.alias("t"), ["pair_id", "page_number"])
    s_tokens, t_tokens = (joined(F.col(f"{x}.normalized_label"), F.col(f"{x}.normalized_value")) for x in "st")
    plain = pairs.select(
        "pair_id", "page_number", F.col("s.ord").alias("i"), F.col("t.ord").alias("j"), similarity.text_similarity(F.col("s.normalized_label"), F.col("t.normalized_label")).alias("label"),
        similarity.text_similarity(F.col("s.normalized_value"), F.col("t.normalized_value")).alias("value"),
        F.when((s_tokens != "") & (t_tokens != ""), similarity.token_overlap(s_tokens, t_tokens)).alias("overlap"),
    )
    expected = {tuple(x)[:4]: tuple(x)[4:] for x in plain.collect()}
    assert len(expected) == len(found[32])
    for pair, page, i, j, _, label, value, overlap, *_ in found[32]:
        own = expected[pair, page, i, j]
        assert (label, value) == pytest.approx(own[:2]) and (own[2] is None or overlap == pytest.approx(own[2]))


def best(n, m, edges):
    """The objective by brute force: links up to one fewer than the smaller side come before weight."""
    top = None
    for k in range(min(n, m) + 1):
        for rows in combinations(range(n), k):
            for cols in permutations(range(m), k):
                if all(e in edges for e in zip(rows, cols)):
                    key = (min(k, min(n, m) - 1), round(sum(edges[e] for e in zip(rows, cols)), 6))
                    top = max(top, key) if top else key
    return top


def test_assignment(spark):
    r = random.Random(4)
    cases = {0: (2, 2, {(0, 0): 0.90, (0, 1): 0.86, (1, 0): 0.99, (1, 1): 0.85})}
    for c in range(1, 60):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        cases[c] = (n, m, {(i, j): round(r.random() ** 3, 6) for i in range(n) for j in range(m) if r.random() < 0.6})
    scored = spark.createDataFrame([(c, 1, i, j, w) for c, (_, _, e) in cases.items() for (i, j), w in e.items()], "pair_id long, page_number int, s_ord long, t_ord long, composite double")
    side = lambda k: spark.createDataFrame([(c, i) for c, v in cases.items() for i in range(v[k])], "pair_id long, ord long")
    got = {}
    for x in matching.assign(scored, side(0), side(1), CompareConfig()).collect():
        got.setdefault(x.pair_id, []).append((x.s_ord, x.t_ord))
    assert sorted(got[0]) == [(0, 1), (1, 0)]
    for c, (n, m, e) in cases.items():
        own = got.get(c, [])
        assert len({i for i, _ in own}) == len({j for _, j in own}) == len(own)
        assert (min(len(own), min(n, m) - 1), round(sum(e[x] for x in own), 6)) == pytest.approx(best(n, m, e)), (c, own)


def test_each_count_of_links_is_solved_best():
    r = random.Random(9)
    for _ in range(300):
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        edges = {(i, j): r.randrange(1, 9) for i in range(n) for j in range(m) if r.random() < 0.7}
        weights, linked = np.zeros((n, m), np.int64), np.zeros((n, m), bool)
        for (i, j), w in edges.items():
            weights[i, j], linked[i, j] = w, True
        most = {}
        for k in range(min(n, m) + 1):
            for rows in combinations(range(n), k):
                for cols in permutations(range(m), k):
                    if all(e in edges for e in zip(rows, cols)):
                        most[k] = max(most.get(k, 0), sum(edges[e] for e in zip(rows, cols)))
        full, short = ({(i, j) for i, j in enumerate(x.tolist()) if j >= 0} for x in matching.best_links(weights, linked))
        assert (len(full), sum(edges[e] for e in full)) == max(most.items())
        assert sum(edges[e] for e in short) == most[max(len(full) - 1, 0)] and len(short) == max(len(full) - 1, 0)


def test_large_pages_end():
    weights = np.random.default_rng(1).integers(400_000, 1_000_000, (500, 520))
    full, short = matching.best_links(weights, weights > 600_000)
    assert (full >= 0).sum() == 500 and len(set(full.tolist())) == 500 and (short >= 0).sum() == 499


def greedy(edges):
    rows, cols, out = set(), set(), set()
    for w, i, j in sorted((-w, i, j) for (i, j), w in edges.items()):
        if i not in rows and j not in cols:
            rows.add(i), cols.add(j), out.add((i, j))
    return out


def test_mutual_best_is_greedy(spark):
    r = random.Random(5)
    cases = {c: {(i, j): float(r.randrange(5)) for i in range(6) for j in range(6) if r.random() < 0.7} for c in range(60)}
    edges = spark.createDataFrame([(c, i, j, w) for c, e in cases.items() for (i, j), w in e.items()], "pair_id long, s_ord long, t_ord long, score double")
    got = {}
    for x in matching.mutual_best(edges, cut=checkpointed).collect():
        got.setdefault(x.pair_id, set()).add((x.s_ord, x.t_ord))
    assert all(got.get(c, set()) == greedy(e) for c, e in cases.items())


@pytest.mark.parametrize("block", [2, 32])
def test_greedy_lines_take_equal_ones_first(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    from palimpsest.functions.similarity import ratio_of

    r = random.Random(6)
    words = ["alpha", "beta", "beta x", "betas", "gamma ray", "gamma", "", "a long line of many words", "a long line of more words", "al"]
    sides = [[(c, i, r.choice(words)) for c in range(20) for i in range(6)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "pair_id long, ord long, normalized string") for s in sides)
    got = {}
    for x in matching.greedy_links(a, b, 70.0, cut=checkpointed).collect():
        got.setdefault(x.pair_id, set()).add((x.s_ord, x.t_ord))
    for c in range(20):
        s, t = ({i: w for k, i, w in side if k == c} for side in sides)
        assert got.get(c, set()) == greedy({(i, j): ratio_of(v, w) for i, v in s.items() for j, w in t.items() if ratio_of(v, w) >= 70})


def test_sequential_links(spark):
    a = spark.createDataFrame([(1, 0, "b a"), (1, 1, "a b"), (1, 2, "zz")], "pair_id long, ord long, key string")
    b = spark.createDataFrame([(1, 0, "a b"), (1, 1, "a c")], "pair_id long, ord long, key string")
    assert sorted((r.s_ord, r.t_ord) for r in matching.sequential_links(a, b).collect()) == [(0, 0), (1, 1)]


def test_take_in_order_is_the_plain_loop():
    from palimpsest.functions.similarity import ratio_of

    r = random.Random(7)
    for _ in range(300):
        a, b = (["".join(r.choice("abc ") for _ in range(r.randrange(7))) for _ in range(r.randrange(9))] for _ in range(2))
        used, expected = set(), []
        for i, x in enumerate(a):
            scores = [(-ratio_of(x, y), j) for j, y in enumerate(b) if j not in used]
            if scores:
                w, j = min(scores)
                used.add(j)
                expected.append((i, j, -w))
        assert matching.take_in_order(a, b) == expected


def test_legacy_align_passes_pages(spark, tmp_path):
    from palimpsest.plans import catalogue

    # Of 24 lines on three pages, those with (31 + 17 * ord) % 10 == 0 go and new ones come in the revision.
    text = "\n".join(["twin line"] + [f"line {i} {'abcdefghijklmnopqrstuvwxyz'[i] * 9}" for i in range(1, 24)])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.s_ord: r.t_ord for r in catalogue.legacy_align(spark, str(tmp_path)).collect()}
    source, target = (x.orderBy("ord").collect() for x in catalogue._fields(spark, str(tmp_path)))
    from palimpsest.functions.similarity import ratio_of

    tokens, used, expected = lambda x: " ".join(sorted(x.normalized_value.split())), set(), {}
    for x in source:
        scores = [(-ratio_of(tokens(x), tokens(y)), y.ord) for y in target if y.ord not in used]
        if scores:
            expected[x.ord] = min(scores)[1]
            used.add(expected[x.ord])
    page = {("s", x.ord): x.page_number for x in source} | {("t", x.ord): x.page_number for x in target}
    assert got == expected and any(page["s", s] != page["t", t] for s, t in got.items())


def test_pages_gate_and_rows(spark):
    cfg = CompareConfig.service()
    a, b = fields(spark, [(1, 0, 1, "DIM 12 x 24", ""), (1, 1, 1, "DIM 6 x 8", ""), (2, 0, 1, "same", "")]), fields(spark, [(1, 0, 1, "DIM 6 x 8", ""), (1, 1, 1, "DIM 12 x 24", ""), (2, 0, 2, "same", "")])
    rows = compare.compare(a, b, cfg, cut=checkpointed).collect()
    assert {(r.s_ord, r.t_ord) for r in rows if r.pair_id == 1} == {(0, 1), (1, 0)}
    assert sorted(r.match_type for r in rows if r.pair_id == 2) == ["extra_in_target", "missing_in_target"]
    assert [r.match_type for r in compare.compare(a, b, patched(cfg, {"cross_page": True}), cut=checkpointed).filter("pair_id = 2").collect()] == ["exact_match"]
    counted = classify.summary(compare.compare(a, b, cfg, cut=checkpointed)).orderBy("pair_id").collect()
    assert [tuple(r) for r in counted] == [(1, 2, 2, 0, 0, 0, 0), (2, 1, 0, 0, 1, 1, 0)]


def test_flags(spark):
    cfg = CompareConfig.service()
    rows = compare.compare(fields(spark, [(1, 0, 1, "alpha beta", "SCALE"), (1, 1, 1, "only here", "NOTE")]), fields(spark, [(1, 0, 1, "alpha gamma zeta", "SCALE")]), cfg, cut=checkpointed)
    got = [(r.type, r.severity, r.reason) for r in classify.ordered(classify.flags(classify.with_certainties(rows))).collect()]
    assert [g[:2] for g in got] == [("changed_value", "medium"), ("missing_information", "medium")] or got[0][0] == "changed_value"
    assert got[-1][2].startswith("[rule:missing_information] Source field absent on target drawing; field_type=ocr_region; critical_field=False")


def test_settings():
    with pytest.raises(ValueError):
        patched(CompareConfig(), {"nonsense": 1})
    with pytest.raises(ValueError):
        checked_thresholds(0.5, match=50, candidate=60)
    assert checked_thresholds(0.92) == pytest.approx((91.96, 70.24))
    service = CompareConfig.service()
    assert (service.partial_min, service.uncertain_max, service.changed_value_max, service.min_pair_composite) == pytest.approx((0.65, 0.55, 0.9, 0.4))

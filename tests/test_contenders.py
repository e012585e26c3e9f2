"""Pages are assigned from few scored pairs, with the result of scoring all."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import CompareConfig
from palimpsest.functions import similarity
from palimpsest.operators import compare, contenders, matching
from palimpsest.plans import catalogue, sheets
from palimpsest.scratch import checkpointed
from palimpsest.sources import fixtures

SMALL = "/root/testdata/sf0.001"
WORDS = ["a\u00a0b", "c  d", "K\u212aX", "alpha", "beta", "b2", "gamma ray", "12 x 4", "é", "-", "", "delta-7", "x", "2024-01-05"]


def test_heaviest_by_brute_force():
    r = random.Random(3)
    for _ in range(400):
        n = r.randrange(1, 6)
        m = r.randrange(n, 7)
        w = [[r.choice((0, 0, r.randrange(1, 9))) for _ in range(m)] for _ in range(n)]
        found = contenders.heaviest(w)
        assert len(set(found)) == n
        assert sum(w[i][j] for i, j in enumerate(found)) == max(sum(w[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))


def block(r, n, labelled):
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randrange(k))).strip()
    label, value = [text(2) if labelled else "" for _ in range(n)], [text(5) for _ in range(n)]
    return {"label": label, "value": value, "other": ["" if a or b else text(3) for a, b in zip(label, value)], "kind": [r.choice((None, "INTEGER", "DECIMAL")) for _ in range(n)]}


@pytest.mark.parametrize("labelled", [False, True])
def test_settled_pages_have_the_best_links(labelled):
    """Links weigh what the solver over all scores finds, there are as many, and no more come of one link fewer."""
    r, cfg, n_settled = random.Random(7), CompareConfig.service(), 0
    for _ in range(300):
        source, target = block(r, r.randrange(1, 8), labelled), block(r, r.randrange(1, 8), labelled)
        page = contenders.Page(source, target, cfg)
        _, value, overlap = similarity.block_matrices(source, target)
        bounds = page.bounds()
        assert (bounds[0] >= value - 1e-12).all() and (bounds[1] >= overlap - 1e-12).all()
        total = page.composite(value, overlap)
        for i, j in np.ndindex(*total.shape):
            assert page.exact(i, j) == (value[i, j], overlap[i, j])
        linked = total >= cfg.min_pair_composite
        weights = np.where(linked, np.rint(np.clip(total, 0, 1) * matching.UNIT).astype(np.int64), 0)
        full, short = (sum(int(weights[i, j]) for i, j in enumerate(x.tolist()) if j >= 0) for x in matching.best_links(weights, linked))
        count = int((matching.best_links(weights, linked)[0] >= 0).sum())
        if (links := contenders.settled(page)) is None:
            continue
        n_settled += 1
        assert len(links) == count and all(linked[i, j] for i, j, *_ in links)
        assert sum(int(weights[i, j]) for i, j, *_ in links) == full >= short
        assert all((v, o) == (value[i, j], overlap[i, j]) for i, j, v, o in links)
    assert n_settled > 150


def test_few_pairs_are_scored(monkeypatch):
    """Of a revised page of ten long lines, about as many pairs are scored as there are lines."""
    r = random.Random(5)
    lines = [" ".join("".join(r.choice("aeinrst") for _ in range(6)) for _ in range(20)) for _ in range(10)]
    side = lambda x: {"label": [""] * 10, "value": x, "other": [""] * 10, "kind": [None] * 10}
    calls, plain = [], contenders.Page.exact
    monkeypatch.setattr(contenders.Page, "exact", lambda self, i, j: (calls.append((i, j)), plain(self, i, j))[1])
    revised = [t.replace("e", "3") if k in (2, 7) else t + " rev b" if k == 4 else t for k, t in enumerate(lines)]
    page = contenders.Page(side(lines), side(revised), CompareConfig.service())
    assert sorted(x[:2] for x in contenders.settled(page)) == [(k, k) for k in range(10)]
    assert len(calls) <= 30


@pytest.mark.parametrize("fields", [catalogue._fields, sheets._fields])
def test_results_are_those_of_all_candidates(spark, monkeypatch, fields):
    """Outcomes weigh the same, whether all pairs of a page are scored or few, and whether a page is one block or many."""
    cfg = CompareConfig.service()

    def counts():
        rows = compare.compare(*fields(spark, SMALL), cfg, cut=checkpointed)
        n = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("s_ord").isNotNull() & F.col("t_ord").isNotNull(), F.col("composite"))), 4).alias("w"))
        return sorted(map(tuple, n.collect()))

    few = counts()
    monkeypatch.setattr(matching, "BLOCK", 4)
    blocks = counts()
    monkeypatch.setattr(matching, "contenders", matching.candidates)
    assert few == counts() == blocks
    assert len(few) == fields(spark, SMALL)[0].select("pair_id").distinct().count() and fixtures.LINES_PER_PAGE > 4

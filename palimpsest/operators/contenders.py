"""The pairs of records that decide a page's assignment, found with few pairs scored.

A small page is solved over upper bounds of its scores, and only pairs that stand in a solution are
scored: a solution of exact scores over bounds of all others is the best there is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from palimpsest.config import CompareConfig
from palimpsest.functions import similarity

UNIT = 1_000_000
#: Bins of characters; those that share one only raise a bound.
BINS = 128


def heaviest(weights: list[list[int]]) -> list[int]:
    """Each row's column in a heaviest matching of whole weights from 0, with no more rows than columns.

    Shortest augmenting paths; rows first take their best column where it is free.
    """
    n, m = len(weights), len(weights[0])
    top = [max(w) for w in weights]
    low, owner, column = [0] * m, [-1] * m, [-1] * n
    for i, w in enumerate(weights):
        j = w.index(top[i])
        while owner[j] >= 0 and top[i] in w[j + 1 :]:
            j = w.index(top[i], j + 1)
        if owner[j] < 0:
            owner[j], column[i] = i, j
    for start in range(n):
        if column[start] >= 0:
            continue
        distance, via, done = [float("inf")] * m, [-1] * m, [False] * m
        visited, i, before, at = [], start, 0, -1
        while True:
            w, own = weights[i], top[i]
            least, next_at = float("inf"), -1
            for j in range(m):
                if done[j]:
                    continue
                d = before + own - w[j] + low[j]
                if d < distance[j]:
                    distance[j], via[j] = d, at
                if distance[j] < least or (distance[j] == least and owner[j] < 0 <= owner[next_at]):
                    least, next_at = distance[j], j
            before, at = least, next_at
            if owner[at] < 0:
                break
            done[at] = True
            visited.append(at)
            i = owner[at]
        top[start] -= before
        for j in visited:
            top[owner[j]] -= before - distance[j]
            low[j] += before - distance[j]
        while at >= 0:
            i = owner[via[at]] if via[at] >= 0 else start
            owner[at], column[i] = i, at
            at = via[at]
    return column


def _histograms(texts: Sequence[str]) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % BINS
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(rows * BINS + codes, minlength=len(texts) * BINS).reshape(len(texts), BINS)


def _most(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Upper bounds of the ratios of all pairs: no common subsequence is longer than what they share in characters."""
    x, y = _histograms(a), _histograms(b)
    size = x.sum(1)[:, None] + y.sum(1)
    return np.where(size > 0, 2.0 * np.minimum(x[:, None], y).sum(2) / np.maximum(size, 1), 1.0)


def _compatibility(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """:func:`similarity.kinds_compatibility` of all pairs."""
    number = {k: n for n, k in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([number[k] for k in a])[:, None], np.array([number[k] for k in b])
    no_x, no_y = np.array([k is None for k in a])[:, None], np.array([k is None for k in b])
    return np.where(no_x & no_y, 0.75, np.where(no_x | no_y, 0.5, np.where(x == y, 1.0, 0.35)))


@lru_cache(maxsize=1024)
def _labels(source: tuple[str, ...], target: tuple[str, ...]) -> np.ndarray:
    return similarity._text_matrix(list(source), list(target), *(list(map(similarity.sorted_of, side)) for side in (source, target)))


class Page:
    """Scores of all pairs of two lists of records; of those not known, upper bounds."""

    def __init__(self, source: dict[str, list], target: dict[str, list], cfg: CompareConfig) -> None:
        self.s, self.t, self.least = source, target, cfg.min_pair_composite
        bare = np.array([x == "" for x in source["label"]])[:, None] & np.array([x == "" for x in target["label"]])
        rest = 1 - cfg.label_weight
        weight = lambda w: np.where(bare, w / rest, w)
        self.label = _labels(tuple(source["label"]), tuple(target["label"]))
        self.w_label, self.w_value, self.w_token = np.where(bare, 0.0, cfg.label_weight), weight(cfg.value_weight), weight(cfg.token_weight)
        self.kinds = weight(cfg.regex_weight) * _compatibility(source["kind"], target["kind"])
        self._made: tuple[dict, dict] = {}, {}

    def _of(self, side: int, i: int) -> tuple:
        """Value, its sorted tokens, and the tokens of a record that is scored."""
        if (made := self._made[side].get(i)) is None:
            rows = (self.s, self.t)[side]
            made = self._made[side][i] = rows["value"][i], similarity.sorted_of(rows["value"][i]), similarity.record_tokens(*(rows[n][i] for n in similarity.BLOCK_TEXTS))
        return made

    def composite(self, value, overlap, at=...) -> np.ndarray:
        """The weighted sum, in the order of matching.breakdown."""
        return self.w_label[at] * self.label[at] + self.w_value[at] * value + self.w_token[at] * overlap + self.kinds[at]

    def exact(self, i: int, j: int) -> tuple[float, float]:
        """Value similarity and token overlap of one pair; records of equal texts have all in common."""
        if all(self.s[n][i] == self.t[n][j] for n in similarity.BLOCK_TEXTS):
            return 1.0, 1.0
        a, b = self._of(0, i), self._of(1, j)
        return similarity.text_similarity_of(a[0], b[0], a[1], b[1]), similarity.token_overlap_of(a[2], b[2])

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of value similarities and token overlaps. Sorting moves characters and adds none where single spaces part the tokens."""
        sides = [side["value"] for side in (self.s, self.t)]
        value = _most(*sides)
        if not all(map(similarity.is_even, (x for side in sides for x in side))):
            value = np.maximum(value, _most(*(list(map(similarity.sorted_of, side)) for side in sides)))
        return value, np.ones_like(value)


def settled(page: Page) -> list[tuple[int, int, float, float]] | None:
    """The page's best links with value similarity and token overlap, if no other links can count; else None.

    They are both the heaviest of all matchings and one of as many links as possible, so none with one link fewer is heavier.
    """
    value, overlap = page.bounds()
    n, m = value.shape
    bound = page.composite(value, overlap)
    possible = bound >= page.least - 1e-9
    weights = np.where(possible, np.ceil(np.minimum(bound, 1.0) * UNIT) + 1, 0).astype(np.int64)
    rows = weights.tolist()
    turned = n > m
    if turned:
        rows = weights.T.tolist()
    known: dict[tuple[int, int], tuple[float, float]] = {}

    def score(i: int, j: int) -> None:
        known[i, j] = page.exact(i, j)
        total = float(page.composite(*known[i, j], (i, j)))
        weight = round(min(max(total, 0.0), 1.0) * UNIT) if total >= page.least else 0
        possible[i, j] = total >= page.least
        if turned:
            rows[j][i] = weight
        else:
            rows[i][j] = weight

    places = {}
    for j, text in enumerate(page.t["value"]):
        places.setdefault(text, []).append(j)
    for i, text in enumerate(page.s["value"]):
        for j in places.get(text, ()):
            score(i, j)
    while True:
        found = [(j, i) if turned else (i, j) for i, j in enumerate(heaviest(rows))]
        links = [x for x in found if possible[x]]
        if new := [x for x in links if x not in known]:
            for x in new:
                score(*x)
            continue
        if len(links) == min(possible.any(1).sum(), possible.any(0).sum()):
            return [(i, j, *known[i, j]) for i, j in links]
        free_s, free_t = set(range(n)) - {i for i, _ in links}, set(range(m)) - {j for _, j in links}
        if not (new := [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(possible))) if (i, j) not in known and (i in free_s or j in free_t)]):
            return None
        for x in new:
            score(*x)


_FOUND = (("i", IntegerType()), ("j", IntegerType()), *[(n, DoubleType()) for n in similarity.BLOCK_SCORES])
#: What stands in a block of records, besides their places.
BLOCK_COLUMNS = (*similarity.BLOCK_TEXTS, "kind")


def found_pairs(source: dict[str, list], target: dict[str, list], whole: bool, cfg: CompareConfig) -> list[np.ndarray]:
    """Places and scores of pairs of two blocks that may be linked: of a whole page only the links, where these are certain."""
    page = Page(source, target, cfg)
    if whole and (links := settled(page)) is not None:
        i, j = (np.array([x[k] for x in links], np.int32) for k in (0, 1))
        return [i, j, page.label[i, j], np.array([x[2] for x in links], float), np.array([x[3] for x in links], float)]
    _, value, overlap = similarity.block_matrices(source, target)
    i, j = np.nonzero(page.composite(value, overlap) >= cfg.min_pair_composite)
    return [i.astype(np.int32), j.astype(np.int32), page.label[i, j], value[i, j], overlap[i, j]]


def contending(cfg: CompareConfig) -> Callable:
    """found_pairs as a function of columns: BLOCK_COLUMNS of the one side, of the other, and whether both blocks are whole pages."""

    def find(*columns: pd.Series) -> pd.DataFrame:
        out, k = [], len(BLOCK_COLUMNS)
        for row in zip(*columns):
            source, target = ({n: list(x) for n, x in zip(BLOCK_COLUMNS, side)} for side in (row[:k], row[k : 2 * k]))
            out.append(found_pairs(source, target, bool(row[-1]), cfg))
        return pd.DataFrame(out, columns=[n for n, _ in _FOUND])

    made = F.pandas_udf(find, StructType([StructField(n, ArrayType(t)) for n, t in _FOUND]))
    return made.asNondeterministic()  # as similarity.ratio

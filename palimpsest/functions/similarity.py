"""Similarity of strings from longest common subsequences.

Spark has no common-subsequence expression (its edit distance allows substitutions), so the
length is computed in Arrow batches: the rows of the dynamic program are bits of one integer, and
all strings of a batch that one string is compared with stand side by side in it, so that a
character costs a few operations however many they are. Everything around it stays in built-in
columns.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


@lru_cache(maxsize=4096)
def _places(text: str) -> dict[str, int]:
    """For each character, the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with bits that are 0 where the row increases.

    The longer string makes the bits, since a step costs little more for more of them. Carries
    beyond the bits meet no character and are cut off at the end.
    """
    if a == b:
        return len(a)
    if len(a) < len(b):
        a, b = b, a
    if a.startswith(b) or a.endswith(b):
        return len(b)
    rest = full = (1 << len(a)) - 1
    for at in filter(None, map(_places(a).get, b)):
        hit = rest & at
        rest = rest + hit | rest - hit
    return len(a) - (rest & full).bit_count()


#: Short strings, such as labels, come again and again.
_of_short = lru_cache(maxsize=1 << 14)(common_subsequence)


def ratio_of(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in percent; 100 for two empty strings."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


#: Bits of one integer; beyond that, longer ones cost more time than the steps that they save.
LANE_BITS = 1 << 14
#: Steps that lanes must save to be worth making.
LEAST_STEPS = 1_000


class Lanes:
    """Strings side by side, each with one bit above it that takes its carry."""

    def __init__(self, texts: tuple[str, ...]) -> None:
        self.sizes = [len(t) for t in texts]
        self.starts = [0, *accumulate(n + 1 for n in self.sizes)]
        joined = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
        inside = np.ones(len(joined), bool)
        inside[np.array(self.starts[1:], np.int64) - 1] = False
        self.full = self._bits(inside)
        self.places = {chr(c): self._bits((joined == c) & inside) for c in np.unique(joined[inside]).tolist()}

    @staticmethod
    def _bits(at: np.ndarray) -> int:
        return int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")

    def common(self, text: str) -> list[int]:
        """Length of the longest common subsequence of the text with each string."""
        rest = full = self.full
        for at in filter(None, map(self.places.get, text)):
            hit = rest & at
            rest = (rest + hit | rest - hit) & full
        return [n - ((rest >> a) & ((1 << n) - 1)).bit_count() for n, a in zip(self.sizes, self.starts)]


lanes = lru_cache(maxsize=64)(Lanes)


def ratios(a: list[str], b: list[str]) -> list[float]:
    """:func:`ratio_of` of each pair; runs of equal strings in a make good use of the lanes."""
    with_each: dict[str, dict[str, float]] = {}
    for x, y in zip(a, b):
        with_each.setdefault(x, {})[y] = 100.0
    for x, found in with_each.items():
        group, bits = [], 0
        others = [y for y in found if y != x]
        for k, y in enumerate(others):
            group.append(y)
            bits += len(y) + 1
            if bits >= LANE_BITS or k == len(others) - 1:
                if len(x) * (len(group) - 1) < LEAST_STEPS:
                    found.update((z, ratio_of(x, z)) for z in group)
                else:
                    found.update((z, 200.0 * n / (len(x) + len(z))) for z, n in zip(group, lanes(tuple(group)).common(x)))
                group, bits = [], 0
    return [with_each[x][y] for x, y in zip(a, b)]


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")


# Not that it varies: the optimizer would copy a deterministic function into every filter on its result.
ratio = ratio.asNondeterministic()


def _lane_matrix(a: list[str], b: list[str]) -> np.ndarray:
    """Common subsequence lengths of all strings of a with all of b."""
    if sum(map(len, a)) * (len(b) - 1) < LEAST_STEPS * len(a):
        return np.array([[_of_short(x, y) for y in b] for x in a], np.int64).reshape(len(a), len(b))
    out = np.zeros((len(a), len(b)), np.int64)
    group, bits, first = [], 0, 0
    for j, y in enumerate(b):
        group.append(y)
        bits += len(y) + 1
        if bits >= LANE_BITS or j == len(b) - 1:
            side = Lanes(tuple(group))
            seen: dict[str, list[int]] = {}
            for i, x in enumerate(a):
                if (found := seen.get(x)) is None:
                    found = seen[x] = side.common(x)
                out[i, first : j + 1] = found
            group, bits, first = [], 0, j + 1
    return out


def _text_matrix(a: list[str], b: list[str], sorted_a: list[str], sorted_b: list[str]) -> np.ndarray:
    """:func:`text_similarity` of all pairs, with the strings' sorted tokens at hand."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.where((n[:, None] == 0) & (m == 0), 1.0, 0.0)
    if not (n.any() and m.any()):
        return out
    size = n[:, None] + m
    plain = 200.0 * _lane_matrix(a, b) / np.maximum(size, 1)
    of_tokens = np.array([len(x) for x in sorted_a])[:, None] + np.array([len(x) for x in sorted_b])
    tokens = 200.0 * _lane_matrix(sorted_a, sorted_b) / np.maximum(of_tokens, 1)
    tokens[of_tokens == 0] = 100.0
    given = (n[:, None] > 0) & (m > 0)
    return np.where(given, np.maximum(plain, tokens) / 100, out)


def _overlap_matrix(a: list[tuple[list[str], set[str]]], b: list[tuple[list[str], set[str]]]) -> np.ndarray:
    """:func:`token_overlap` of all pairs of :func:`record_tokens`."""
    (sets_a, own_a), (sets_b, own_b) = ([[x[k] for x in side] for k in (0, 1)] for side in (a, b))
    words_a, words_b = ([" ".join(x) for x in side] for side in (sets_a, sets_b))
    keys_a, keys_b = [set(x) for x in sets_a], [set(x) for x in sets_b]
    whole = _lane_matrix(words_a, words_b)
    out = np.empty((len(sets_a), len(sets_b)))
    for i, ka in enumerate(keys_a):
        na = own_a[i]
        for j, kb in enumerate(keys_b):
            nb = own_b[j]
            if not na or not nb:
                out[i, j] = 0.0 if na or nb else 1.0
                continue
            out[i, j] = _overlap(na, nb, _set_ratio(sets_a[i], ka, sets_b[j], kb, words_a[i], words_b[j], int(whole[i, j])))
    return out


def _overlap(alnum_a: set[str], alnum_b: set[str], set_ratio: float) -> float:
    both = len(alnum_a & alnum_b)
    jaccard_share = both / max(len(alnum_a) + len(alnum_b) - both, 1)
    return min(1.0, 0.5 * jaccard_share + set_ratio / 200)


def text_similarity_of(a: str, b: str, sorted_a: str, sorted_b: str) -> float:
    """:func:`text_similarity` of one pair, with the strings' sorted tokens at hand."""
    if not a or not b:
        return 0.0 if a or b else 1.0
    return 1.0 if a == b else max(ratio_of(a, b), ratio_of(sorted_a, sorted_b)) / 100


def token_overlap_of(a: tuple[list[str], set[str]], b: tuple[list[str], set[str]]) -> float:
    """:func:`token_overlap` of one pair of :func:`record_tokens`."""
    (set_a, alnum_a), (set_b, alnum_b) = a, b
    if not alnum_a or not alnum_b:
        return 0.0 if alnum_a or alnum_b else 1.0
    in_a, in_b, words_a, words_b = set(set_a), set(set_b), " ".join(set_a), " ".join(set_b)
    whole = common_subsequence(words_a, words_b) if in_a.isdisjoint(in_b) else 0
    return _overlap(alnum_a, alnum_b, _set_ratio(set_a, in_a, set_b, in_b, words_a, words_b, whole))


def block_matrices(source: dict[str, list[str]], target: dict[str, list[str]]) -> list[np.ndarray]:
    """BLOCK_SCORES of all pairs of two blocks, by the names of BLOCK_TEXTS."""
    texts = [_text_matrix(source[n], target[n], *(list(map(sorted_of, side[n])) for side in (source, target))) for n in ("label", "value")]
    return [*texts, _overlap_matrix(*([record_tokens(*x) for x in zip(*(side[n] for n in BLOCK_TEXTS))] for side in (source, target)))]


def _set_ratio(a: list[str], in_a: set[str], b: list[str], in_b: set[str], text_a: str, text_b: str, whole: int) -> float:
    """:func:`token_set_of` of two sorted token lists; whole is the common subsequence of all tokens, which holds where none is shared."""
    if not a or not b:
        return 0.0
    if in_a.isdisjoint(in_b):
        return 200.0 * whole / max(len(text_a) + len(text_b), 1)
    x, y = " ".join(w for w in a if w not in in_b), " ".join(w for w in b if w not in in_a)
    if not x or not y:
        return 100.0
    n = sum(len(w) + 1 for w in a if w in in_b) - 1
    lead = n + 1
    together = 200.0 * (common_subsequence(x, y) + lead) / max(2 * lead + len(x) + len(y), 1)
    return max(together, 200.0 * n / (n + lead + len(x)), 200.0 * n / (n + lead + len(y)))


#: What the scores of blocks are made from, on both sides: texts of labels and values, and what stands for the two where both are empty.
BLOCK_TEXTS = ("label", "value", "other")
#: White space as ``(?U)\\s`` has it, and what single spaces between tokens are not.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE, _UNEVEN = re.compile(f"[{_SPACES}]+"), re.compile(f"[{_SPACES.replace(' ', '', 1)}]|  |^ | $")
_ALNUM = re.compile("[a-z0-9]+")


def tokens_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def sorted_of(text: str) -> str:
    """:func:`sorted_tokens` of one string."""
    return " ".join(sorted(tokens_of(text)))


def is_even(text: str) -> bool:
    """Whether single spaces, and no others, part the tokens."""
    return _UNEVEN.search(text) is None


def record_tokens(label: str, value: str, other: str) -> tuple[list[str], set[str]]:
    """Sorted distinct tokens of a record's label and value, and their alphanumeric parts."""
    text = f"{label} {value}".strip(" ") or other
    return sorted(set(tokens_of(text))), set(_ALNUM.findall(text.lower()))


BLOCK_SCORES = ("label_similarity", "value_similarity", "token_overlap")


@F.pandas_udf(StructType([StructField(n, ArrayType(DoubleType())) for n in BLOCK_SCORES]))
def block_scores(*columns: pd.Series) -> pd.DataFrame:
    """For two blocks of records, as arrays of BLOCK_TEXTS of the one and of the other: three scores of all pairs, row by row."""
    out = []
    for row in zip(*columns):
        sides = (dict(zip(BLOCK_TEXTS, map(list, side))) for side in (row[: len(BLOCK_TEXTS)], row[len(BLOCK_TEXTS) :]))
        out.append([m.ravel() for m in block_matrices(*sides)])
    return pd.DataFrame(out, columns=list(BLOCK_SCORES))


block_scores = block_scores.asNondeterministic()  # as ratio


@F.pandas_udf(StructType([StructField("i", ArrayType(IntegerType())), StructField("j", ArrayType(IntegerType())), StructField("score", ArrayType(DoubleType()))]))
def block_ratios(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.DataFrame:
    """For two blocks of strings, places and ratios of the pairs that have at least so much."""
    out = []
    for x, y, low in zip(a, b, least):
        x, y = list(x), list(y)
        size = np.array([len(t) for t in x])[:, None] + np.array([len(t) for t in y])
        score = np.where(size > 0, 200.0 * _lane_matrix(x, y) / np.maximum(size, 1), 100.0)
        i, j = np.nonzero(score >= low)
        out.append([i.astype(np.int32), j.astype(np.int32), score[i, j]])
    return pd.DataFrame(out, columns=["i", "j", "score"])


block_ratios = block_ratios.asNondeterministic()


def sorted_tokens(text: Column) -> Column:
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))


def token_parts(x: Column, y: Column) -> dict[str, Column]:
    """Of two sorted sets of tokens, joined: what they share, and what each has alone."""
    joined = lambda c: F.array_join(c, " ")
    return {"shared": joined(F.array_sort(F.array_intersect(x, y))), "own_x": joined(F.array_except(x, y)), "own_y": joined(F.array_except(y, x))}


def token_set_of(empty: Column, shared: Column, own_x: Column, own_y: Column) -> Column:
    """Best of three comparisons of the shared tokens and each side's own; the parts are best made columns before.

    The joined strings share their beginning, so only the rest has to be compared.
    """
    return token_set_from(empty, shared, own_x, own_y, ratio(own_x, own_y))


def token_set_from(empty: Column, shared: Column, own_x: Column, own_y: Column, own: Column) -> Column:
    """:func:`token_set_of` where the ratio of each side's own tokens is at hand."""
    n, x, y = F.char_length(shared), F.char_length(own_x), F.char_length(own_y)
    lead = n + F.when((n > 0) & (x > 0) & (y > 0), 1).otherwise(0)
    rest = F.rint(own * (x + y) / 200)
    both = 200 * (rest + lead) / F.greatest(2 * lead + x + y, F.lit(1))
    alone = lambda m: F.when(n > 0, 200.0 * n / (n + lead + m)).otherwise(0.0)
    return F.when(empty, 0.0).when((n > 0) & ((x == 0) | (y == 0)), 100.0).otherwise(F.greatest(both, alone(x), alone(y)))


def token_set_ratio(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    return token_set_of((F.size(x) == 0) | (F.size(y) == 0), **token_parts(x, y))


def text_similarity(a: Column, b: Column) -> Column:
    """0 to 1: the better of the plain and the token-sorted ratio."""
    return text_similarity_from(a, b, ratio(a, b), token_sort_ratio(a, b))


def text_similarity_from(a: Column, b: Column, plain: Column, tokens: Column) -> Column:
    """:func:`text_similarity` where both ratios are at hand."""
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(plain, tokens) / 100)


def alphanumeric_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard_of(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(shared / F.greatest(F.size(x) + F.size(y) - shared, F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_of(alphanumeric_set(a), alphanumeric_set(b))


def overlap_of(x: Column, y: Column, set_ratio: Column) -> Column:
    """Half the share of common alphanumeric tokens, half the token-set ratio; 1 for none on both sides, 0 for none on one."""
    empty = (F.size(x) == 0, F.size(y) == 0)
    return F.when(empty[0] & empty[1], 1.0).when(empty[0] | empty[1], 0.0).otherwise(F.least(F.lit(1.0), 0.5 * jaccard_of(x, y) + set_ratio / 200))


def token_overlap(a: Column, b: Column) -> Column:
    return overlap_of(alphanumeric_set(a), alphanumeric_set(b), token_set_ratio(a, b))


#: Kinds of values, the first that matches counts (fixed values).
VALUE_PATTERNS = (
    ("ISO_DATE", r"(?U)\b\d{4}-\d{2}-\d{2}\b"),
    ("US_DATE", r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("DIMENSION", r"(?iU)\b\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?\b"),
    ("DECIMAL", r"(?U)\b\d+\.\d+\b"),
    ("INTEGER", r"(?U)\b\d+\b"),
)


def value_kind(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(VALUE_PATTERNS):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return F.when(text.rlike(r"(?U)\d"), out)


def regex_compatibility(a: Column, b: Column) -> Column:
    return kinds_compatibility(value_kind(a), value_kind(b))


def kinds_compatibility(x: Column, y: Column) -> Column:
    return F.when(x.isNull() & y.isNull(), 0.75).when(x.isNull() | y.isNull(), 0.5).when(x == y, 1.0).otherwise(0.35)

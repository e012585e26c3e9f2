"""Linking of source and target records.

Records are rows with ``pair_id`` (which comparison), ``ord`` (place in its side), and for
scored matching ``page_number``, ``normalized_label``, ``normalized_value``, ``label``, ``value``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from palimpsest.config import CompareConfig
from palimpsest.functions import normalize, similarity
from palimpsest.operators.contenders import BLOCK_COLUMNS, UNIT, contending
from palimpsest.scratch import merged

NAMES = ("label", "value", "normalized_label", "normalized_value")
SIGNALS = ("labels_absent", "label_similarity", "value_similarity", "token_overlap", "regex_compatibility")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to the configured number of tasks, few bytes or not: scoring costs far more than moving."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Records of one side in a block; blocks of a page are scored with each other, so a row stays small however dense its page is.
BLOCK = 32


def _blocks(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """A side's records in blocks, as arrays, with all that depends on one record alone computed once a record."""
    text = {n: F.trim(F.coalesce(F.col(n), F.lit(""))) for n in NAMES}
    label, value = text["normalized_label"], text["normalized_value"]
    other = F.when((label == "") & (value == ""), normalize.canonical_key(text["label"], text["value"])).otherwise("")
    kind = similarity.value_kind(F.when(value != "", value).otherwise(text["value"]))
    names = ("ord", *similarity.BLOCK_TEXTS, "kind")
    first = df.select(*keys, F.col("ord").alias("ord"), label.alias("label"), value.alias("value"), other.alias("other"), kind.alias("kind"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("ord"))
    rows = F.count("*").over(W.partitionBy(*keys))
    numbered = dealt(first, *keys).withColumn("block", F.floor((place - 1) / BLOCK)).withColumn("whole", rows <= BLOCK)
    packed = numbered.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"), F.first("whole").alias(f"{side}_whole"))
    return packed.select(*keys, f"{side}_whole", *[F.col(f"rows.{c}").alias(f"{side}_{c}") for c in names])


def _met(source: DataFrame, target: DataFrame, cfg: CompareConfig) -> tuple[list[str], DataFrame]:
    """What keeps records apart, and all pairs of blocks that this leaves."""
    keys = ["pair_id"] if cfg.cross_page else ["pair_id", "page_number"]
    return keys, _blocks(source, "s", keys).join(merged(_blocks(target, "t", keys)), keys)


def breakdown(source: DataFrame, target: DataFrame, cfg: CompareConfig) -> DataFrame:
    """Pairs of one comparison, and of one page unless pages may differ, with the four signals and their weighted sum.

    Blocks of records are paired and scored, so that texts travel once a block and not once a pair.
    """
    keys, met = _met(source, target, cfg)
    scores = similarity.block_scores(*[F.col(f"{side}_{c}") for side in "st" for c in similarity.BLOCK_TEXTS])
    names = similarity.BLOCK_SCORES
    scored = met.withColumn("scores", scores).select(
        *keys, *[f"{side}_{c}" for side in "st" for c in ("ord", "kind")], F.transform("s_label", lambda x: x == "").alias("s_bare"), F.transform("t_label", lambda x: x == "").alias("t_bare"),
        F.posexplode(F.arrays_zip(*[F.col(f"scores.{n}") for n in names])).alias("at", "score"),
    )
    i, j = F.floor(F.col("at") / F.size("t_ord")).cast("int"), (F.col("at") % F.size("t_ord")).cast("int")
    return _pairs(scored, keys, i, j, cfg)


def _pairs(scored: DataFrame, keys: list[str], i: Column, j: Column, cfg: CompareConfig) -> DataFrame:
    """Pairs at places i and j of two blocks, with their column ``score``, as signals and weighted sum."""
    pairs = scored.select(
        *keys, F.get("s_ord", i).alias("s_ord"), F.get("t_ord", j).alias("t_ord"), (F.get("s_bare", i) & F.get("t_bare", j)).alias("labels_absent"),
        *[F.col("score")[n].alias(n) for n in similarity.BLOCK_SCORES], similarity.kinds_compatibility(F.get("s_kind", i), F.get("t_kind", j)).alias("regex_compatibility"),
    )
    rest = 1 - cfg.label_weight
    weight = lambda w: F.when(F.col("labels_absent"), w / rest).otherwise(w)
    total = (
        F.when(F.col("labels_absent"), 0.0).otherwise(cfg.label_weight) * F.col("label_similarity")
        + weight(cfg.value_weight) * F.col("value_similarity")
        + weight(cfg.token_weight) * F.col("token_overlap")
        + weight(cfg.regex_weight) * F.col("regex_compatibility")
    )
    return pairs.select(*keys, "s_ord", "t_ord", *SIGNALS, total.alias("composite"))


def candidates(source: DataFrame, target: DataFrame, cfg: CompareConfig) -> DataFrame:
    """Scored pairs that may be linked."""
    return breakdown(source, target, cfg).filter(F.col("composite") >= cfg.min_pair_composite)


def contenders(source: DataFrame, target: DataFrame, cfg: CompareConfig) -> DataFrame:
    """The candidates that decide the assignment: of a page of one block a side its links, where these are certain; of others all.

    Few pairs of such a page have to be scored, and its links are all that is moved on.
    """
    keys, met = _met(source, target, cfg)
    found = contending(cfg)(*[F.col(f"{side}_{c}") for side in "st" for c in BLOCK_COLUMNS], F.col("s_whole") & F.col("t_whole"))
    scored = met.withColumn("found", found).select(
        *keys, *[f"{side}_{c}" for side in "st" for c in ("ord", "kind")], F.transform("s_label", lambda x: x == "").alias("s_bare"), F.transform("t_label", lambda x: x == "").alias("t_bare"),
        F.explode(F.arrays_zip(*[F.col(f"found.{n}") for n in ("i", "j", *similarity.BLOCK_SCORES)])).alias("score"),
    )
    return _pairs(scored, keys, F.col("score.i"), F.col("score.j"), cfg).filter(F.col("composite") >= cfg.min_pair_composite)


def best_links(weights: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heaviest matching of the most links, and the heaviest with one link fewer: each row's column, or -1.

    weights are whole numbers, linked tells which pairs may be taken. Shortest augmenting paths
    over costs of the opposite sign, from all free rows at once, so each count's best follows from
    the one before; potentials keep costs of unused pairs from being negative, and a step of the
    search is one operation over a row.
    """
    n, m = weights.shape
    far = np.iinfo(np.int64).max // 4
    cost = np.where(linked, -weights, far)
    row, column = np.full(n, -1), np.full(m, -1)
    p_row, p_column = np.zeros(n, np.int64), cost.min(axis=0, initial=far)
    before = row.copy()
    while True:
        free = row < 0
        reduced = np.where(linked[free], cost[free] + p_row[free, None] - p_column, far)
        if not reduced.size:
            return row, before
        distance, via = reduced.min(axis=0), np.flatnonzero(free)[reduced.argmin(axis=0)]
        done, d_row = np.zeros(m, bool), np.where(free, 0, far)
        end, least = -1, far
        while True:
            left = np.where(done, far, distance)
            j = int(left.argmin())
            if left[j] >= far or left[j] + p_column.min(initial=0) > least:
                break
            done[j] = True
            i = int(column[j])
            if i < 0:
                if distance[j] + p_column[j] < least:
                    end, least = j, int(distance[j] + p_column[j])
                continue
            d_row[i] = distance[j]
            through = np.where(linked[i], distance[j] + cost[i] + p_row[i] - p_column, far)
            nearer = ~done & (through < distance)
            distance[nearer], via[nearer] = through[nearer], i
        if end < 0:
            return row, before
        before = row.copy()
        most = distance[done].max()
        p_row += np.minimum(d_row, most)
        p_column += np.minimum(distance, most)
        p_row[free] = 0
        while True:
            i = int(via[end])
            row[i], column[end], end = end, i, int(row[i])
            if end < 0:
                break


#: Edges of a page that is solved among others of a batch; a larger one comes alone.
PACKED = 400


def _page_links(s_ord: np.ndarray, t_ord: np.ndarray, composite: np.ndarray) -> tuple[list[int], list[int], list[bool], list[bool], float]:
    """Places of a page's links, which of them stand in the best links and which in the best with one fewer, and what that gains."""
    s, i = np.unique(s_ord, return_inverse=True)
    t, j = np.unique(t_ord, return_inverse=True)
    weights, linked = np.zeros((len(s), len(t)), np.int64), np.zeros((len(s), len(t)), bool)
    weights[i, j] = np.rint(np.clip(composite, 0.0, 1.0) * UNIT)
    linked[i, j] = True
    full, short = ({(a, int(b)) for a, b in enumerate(found.tolist()) if b >= 0} for found in best_links(weights, linked))
    gain = int(sum(weights[x] for x in short) - sum(weights[x] for x in full))
    links = sorted(full | short)
    return s[[a for a, _ in links]].tolist(), t[[b for _, b in links]].tolist(), [x in full for x in links], [x in short for x in links], gain / UNIT


_SOLVED = (("s_ord", ArrayType(LongType())), ("t_ord", ArrayType(LongType())), ("full", ArrayType(BooleanType())), ("short", ArrayType(BooleanType())), ("gain", DoubleType()))


@F.pandas_udf(StructType([StructField(n, t) for n, t in _SOLVED]))
def _solved(s_ord: pd.Series, t_ord: pd.Series, composite: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_page_links(*page) for page in zip(s_ord, t_ord, composite)], columns=[n for n, _ in _SOLVED])


_solved = _solved.asNondeterministic()  # as similarity.ratio


_ASSIGNED = "pair_id {0}, page_number int, s_ord long, t_ord long, full boolean, short boolean, gain double"


def assign(scored: DataFrame, source: DataFrame, target: DataFrame, cfg: CompareConfig) -> DataFrame:
    """One-to-one links (pair_id, s_ord, t_ord).

    The objective: first as many links as the edges allow, up to one fewer than the smaller
    side; then the most total weight. Each page is solved alone; only where all pages together
    link the whole smaller side may one link go, that whose loss gains most. Edges without a rival
    at either end are links whatever else is, so only the others are solved.
    """
    keys = ["pair_id"] if cfg.cross_page else ["pair_id", "page_number"]
    kind = scored.schema["pair_id"].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        page = int(group.page_number.iloc[0]) if "page_number" in group else 0
        s, t, full, short, gain = _page_links(*(group[n].to_numpy() for n in ("s_ord", "t_ord", "composite")))
        return pd.DataFrame({"pair_id": group.pair_id.iloc[0], "page_number": page, "s_ord": s, "t_ord": t, "full": full, "short": short, "gain": gain})

    rivals = lambda *end: F.count("*").over(W.partitionBy(*keys, *end))
    edges = dealt(scored.select(*keys, "s_ord", "t_ord", "composite"), *keys).withColumn("alone", (rivals("s_ord") == 1) & (rivals("t_ord") == 1)).withColumn("n", rivals())
    page = F.col("page_number") if "page_number" in keys else F.lit(0)
    sure = [F.lit(True).alias("full"), F.lit(True).alias("short"), F.lit(-1.0).alias("gain")]
    alone = edges.filter("alone").select("pair_id", page.cast("int").alias("page_number"), F.col("s_ord").cast("long").alias("s_ord"), F.col("t_ord").cast("long").alias("t_ord"), *sure)
    large = edges.filter(~F.col("alone") & (F.col("n") > PACKED)).drop("alone", "n").groupBy(*keys).applyInPandas(solve, _ASSIGNED.format(kind))
    packed = edges.filter(~F.col("alone") & (F.col("n") <= PACKED)).groupBy(*keys).agg(F.collect_list(F.struct("s_ord", "t_ord", "composite")).alias("e"))
    found = packed.select("pair_id", page.cast("int").alias("page_number"), _solved("e.s_ord", "e.t_ord", "e.composite").alias("found"))
    names = ("s_ord", "t_ord", "full", "short")
    small = found.select("pair_id", "page_number", F.explode(F.arrays_zip(*[F.col(f"found.{n}") for n in names])).alias("link"), "found.gain").select("pair_id", "page_number", *[F.col(f"link.{n}") for n in names], "gain")
    solved = small.unionByName(large).unionByName(alone)
    sizes = source.groupBy("pair_id").agg(F.count("*").alias("n")).join(merged(target.groupBy("pair_id").agg(F.count("*").alias("m"))), "pair_id")
    best = solved.groupBy("pair_id").agg(
        F.sum(F.col("full").cast("int")).alias("links"), F.max(F.struct("gain", (-F.col("page_number")).alias("page"))).alias("best")
    )
    spare = best.join(merged(sizes), "pair_id").filter((F.col("links") == F.least("n", "m")) & (F.col("best.gain") > 0)).select("pair_id", (-F.col("best.page")).alias("shorter"))
    chosen = solved.join(merged(spare), "pair_id", "left").filter(F.when(F.col("shorter") == F.col("page_number"), F.col("short")).otherwise(F.col("full")))
    return chosen.select("pair_id", "s_ord", "t_ord")


def mutual_best(edges: DataFrame, *, cut) -> DataFrame:
    """Greedy one-to-one links by (score descending, s_ord, t_ord), in rounds.

    An edge that is the first of both its ends in that order is also taken by the sequential
    greedy rule; taking all such edges at once and dropping those they touch gives its result.
    ``cut`` ends the lineage of a round.
    """
    order = F.struct((-F.col("score")).alias("score"), "s_ord", "t_ord")
    left = cut(edges.select("pair_id", "s_ord", "t_ord", "score"))
    found = None
    while not left.isEmpty():
        ranked = left.withColumn("order", order)
        by_s = ranked.groupBy("pair_id", "s_ord").agg(F.min("order").alias("best"))
        by_t = ranked.groupBy("pair_id", "t_ord").agg(F.min("order").alias("best"))
        taken = cut(
            by_s.select("pair_id", "best").join(merged(by_t.select("pair_id", "best")), ["pair_id", "best"]).select("pair_id", "best.s_ord", "best.t_ord", (-F.col("best.score")).alias("score"))
        )
        found = taken if found is None else found.unionByName(taken)
        left = cut(left.join(merged(taken.select("pair_id", "s_ord")), ["pair_id", "s_ord"], "left_anti").join(merged(taken.select("pair_id", "t_ord")), ["pair_id", "t_ord"], "left_anti"))
    return found if found is not None else left


def _by_length(lines: DataFrame, side: str) -> DataFrame:
    """Blocks of a document's lines (pair_id, ord, normalized), from short ones to long ones, with the lengths that they span."""
    size = F.char_length("normalized")
    place = F.row_number().over(W.partitionBy("pair_id").orderBy("size", "ord"))
    numbered = dealt(lines.select("pair_id", "ord", F.col("normalized").alias("text"), size.alias("size")), "pair_id").withColumn("block", F.floor((place - 1) / BLOCK))
    packed = numbered.groupBy("pair_id", "block").agg(F.array_sort(F.collect_list(F.struct("size", "ord", "text"))).alias("rows"), F.min("size").alias(f"{side}_low"), F.max("size").alias(f"{side}_high"))
    return packed.select("pair_id", F.col("rows.ord").alias(f"{side}_ords"), F.col("rows.text").alias(f"{side}_texts"), f"{side}_low", f"{side}_high")


def line_edges(source: DataFrame, target: DataFrame, min_score: float) -> DataFrame:
    """(pair_id, s_ord, t_ord, score) of the pairs of lines whose ratio is at least so much.

    Blocks meet only where some lengths in them allow that score, and only pairs that reach it come back.
    """
    met = _by_length(source, "s").join(merged(_by_length(target, "t")), "pair_id")
    share = min_score / (200.0 - min_score)  # of the longer line that the shorter one must have
    possible = (F.col("s_high") >= F.col("t_low") * share - 1e-9) & (F.col("t_high") >= F.col("s_low") * share - 1e-9)
    found = met.filter(possible).withColumn("found", similarity.block_ratios("s_texts", "t_texts", F.lit(float(min_score))))
    each = found.select("pair_id", "s_ords", "t_ords", F.explode(F.arrays_zip("found.i", "found.j", "found.score")).alias("e"))
    return each.select("pair_id", F.get("s_ords", F.col("e.i")).alias("s_ord"), F.get("t_ords", F.col("e.j")).alias("t_ord"), F.col("e.score").alias("score"))


def greedy_links(source: DataFrame, target: DataFrame, min_score: float, *, cut) -> DataFrame:
    """Greedy links of lines (pair_id, ord, normalized) by ratio.

    Equal lines score 100 and come first, in order: the k-th of a text in the source goes to the
    k-th in the target, by a join on rank. Only what is left is scored.
    """

    def numbered(df: DataFrame, side: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("pair_id", "normalized").orderBy("ord"))
        return df.select("pair_id", F.col("ord").alias(side), "normalized", rank.alias("k"))

    equal = cut(numbered(source, "s_ord").join(merged(numbered(target, "t_ord")), ["pair_id", "normalized", "k"]).select("pair_id", "s_ord", "t_ord", F.lit(100.0).alias("score")))
    edges = line_edges(unmatched(source, equal, "s"), unmatched(target, equal, "t"), min_score)
    return equal.unionByName(mutual_best(edges, cut=cut))


def take_in_order(sources: list[str], targets: list[str]) -> list[tuple[int, int, float]]:
    """Places of links, and scores: each source in order takes the best free target, the first of equals.

    Equal texts alone score 100, so the first free one is taken unscored. Other targets stand as
    distinct texts by length; those whose length allows no better score than the best are not scored.
    """
    free: dict[str, deque[int]] = {}
    for j, text in enumerate(targets):
        free.setdefault(text, deque()).append(j)
    by_length: dict[int, dict[str, None]] = {}
    for text in free:
        by_length.setdefault(len(text), {})[text] = None
    out, left = [], len(targets)
    for i, own in enumerate(sources):
        if not left:
            break
        if own in free:
            score, text = 100.0, own
        else:
            bound = lambda n: 200.0 * min(len(own), n) / (len(own) + n)
            best: tuple[float, int, str] | None = None
            for n in sorted(by_length, key=bound, reverse=True):
                if best is not None and bound(n) < -best[0]:
                    break
                for other in by_length[n]:
                    found = (-similarity.ratio_of(own, other), free[other][0], other)
                    if best is None or found < best:
                        best = found
            score, text = -best[0], best[2]
        out.append((i, free[text].popleft(), score))
        left -= 1
        if not free[text]:
            del free[text], by_length[len(text)][text]
            if not by_length[len(text)]:
                del by_length[len(text)]
    return out


def sequential_links(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source record in order takes the best free target by token-sorted ratio; the first wins ties, and there is no least score.

    A comparison is one task's: it holds both sides' keys, and no pairs of them.
    """
    kind = source.schema["pair_id"].dataType.simpleString()

    def take(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        s, t = s.sort_values("ord"), t.sort_values("ord")
        links = take_in_order(s.key.fillna("").tolist(), t.key.fillna("").tolist()) if len(s) and len(t) else []
        i, j = [x[0] for x in links], [x[1] for x in links]
        pair = s.pair_id.iloc[0] if len(s) else t.pair_id.iloc[0]
        return pd.DataFrame({"pair_id": pair, "s_ord": s.ord.to_numpy()[i] if i else [], "t_ord": t.ord.to_numpy()[j] if j else [], "score": [x[2] for x in links]})

    sides = [dealt(df.select("pair_id", "ord", similarity.sorted_tokens(F.col("key")).alias("key")), "pair_id").groupBy("pair_id") for df in (source, target)]
    return sides[0].cogroup(sides[1]).applyInPandas(take, f"pair_id {kind}, s_ord long, t_ord long, score double")


def unmatched(records: DataFrame, links: DataFrame, side: str) -> DataFrame:
    """Records of a side without a link."""
    return records.join(merged(links.select("pair_id", F.col(f"{side}_ord").alias("ord"))), ["pair_id", "ord"], "left_anti")

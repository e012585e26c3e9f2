"""Language identification with string kernels.

A text is the set of its lower-cased byte n-grams of one to three bytes, each hashed to one of
``DIMENSIONS`` places. The blended-spectrum presence kernel of two texts is the size of the
intersection of their sets over the geometric mean of their sizes. ``LANDMARKS`` training texts
a language span a Nyström feature space K(x, L) K(L, L)^-1/2, in which one-versus-rest kernel
ridge regression is solved in closed form. Scoring multiplies presence rows by one matrix, the
landmarks' presence times their weights: a batched product whose cost does not depend on the
number of landmarks.

Only fitting samples: at most ``SAMPLE`` labelled rows a language, those with the least hash of
their id among the rows outside the held-out fifth, reach the driver as ``DIMENSIONS`` bits
each. Every text is scored whole.

Cases: null texts and texts without a letter are ``und`` with score 0; where no row has a
language all are; repeated rows are scored alike; empty tables give empty results; language,
source and id are never inputs of a prediction; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import LOWER_BYTE, U, buffers, mix, slices

GRAMS, DIMENSIONS = (1, 2, 3), 1 << 15
SAMPLE, LANDMARKS = 400, 64
RIDGE, SHARPNESS = 1e-3, 6.0
FOLDS = 5
ROWS, SLICE_BYTES = 64, 1 << 20
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def held_out() -> Column:
    """Whether a document stays out of the fit; one without doc_id counts as if that were the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def presence(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of booleans for each text."""
    out = np.zeros((len(at) - 1, DIMENSIONS), bool)
    if not len(raw):
        return out
    low = LOWER_BYTE[raw].astype(U)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = at[1:][row] - np.arange(len(raw))
    code = np.zeros(len(raw), U)
    for n in range(1, max(GRAMS) + 1):
        code = (code[: len(raw) - n + 1] << U(8)) | low[n - 1 :]
        if n in GRAMS:
            whole = left[: len(code)] >= n
            place = (mix(code[whole] + (U(n) << U(56))) >> U(64 - 15)).astype(np.int64)
            out[row[: len(code)][whole], place] = True
    return out


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    counts = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    out = counts[at[1:]] > counts[at[:-1]]
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])):
        out[i] = any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode()))
    return out


class Model:
    """Weights of hashed n-grams for each language."""

    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights.astype(np.float32)

    def scores(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
        return (bits.astype(np.float32) @ self.weights) / size[:, None]

    def predict(self, bits: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = np.exp(SHARPNESS * self.scores(bits).astype(np.float64))
        share = margin / margin.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.languages[i] for i in best], share[np.arange(len(best)), best]


def solve(bits: np.ndarray, labels: np.ndarray, languages: list[str], landmarks: int) -> Model:
    """Nyström features of the rows and ridge regression on them; labels are places in languages."""
    x = bits.astype(np.float64)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    chosen = np.concatenate([np.flatnonzero(labels == k)[:landmarks] for k in range(len(languages))])
    mark = x[chosen]
    values, vectors = np.linalg.eigh(mark @ mark.T)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = (x @ mark.T) @ root
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    counts = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / (len(languages) * counts))[labels][:, None]
    ridge = np.linalg.solve(z.T @ (weight * z) + RIDGE * len(labels) * np.eye(z.shape[1]), z.T @ (weight * target))
    return Model(languages, mark.T @ (root @ ridge))


def fit(documents: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    usable = documents.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return None
    # A hash threshold for each language that some more than the sample pass.
    order = F.xxhash64(F.lit("sample"), "doc_id")
    odds = {k: min(1.0, (1.3 * sample + 50) / n) for k, n in counts.items()}
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(int(p * (1 << 64)) - (1 << 63), (1 << 63) - 1))) for k, p in odds.items()])
    rows = usable.filter(order <= limit).select("lang", order.alias("order"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            raw, at = buffers(part.column(2))
            packed = np.packbits(presence(raw, at), axis=1)
            yield pa.record_batch({"lang": part.column(0), "order": part.column(1), "bits": pa.array([x.tobytes() for x in packed], pa.binary())})

    own: dict[str, list[tuple[int, bytes]]] = {k: [] for k in languages}
    for r in rows.mapInArrow(run, "lang string, order long, bits binary").collect():
        own[r.lang].append((r.order, bytes(r.bits)))
    taken = [(k, b) for k, name in enumerate(languages) for _, b in sorted(own[name])[:sample]]
    bits = np.unpackbits(np.frombuffer(b"".join(b for _, b in taken), np.uint8).reshape(len(taken), -1), axis=1)
    return solve(bits, np.array([k for k, _ in taken]), languages, landmarks)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part in slices(batches, "text", SLICE_BYTES):
            raw, at = buffers(part.column(2))
            language, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            good = np.flatnonzero(has_letter(raw, at)) if known else []
            for a in range(0, part.num_rows, ROWS) if len(good) else ():
                b = min(a + ROWS, part.num_rows)
                names, share = known.predict(presence(raw[at[a] : at[b]], at[a : b + 1] - at[a]))
                score[a:b] = share
                language[a:b] = names
            bad = np.setdiff1d(np.arange(part.num_rows), good)
            score[bad] = 0
            for i in bad.tolist():
                language[i] = UNKNOWN
            yield pa.record_batch({"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": pa.array(language, pa.string()), "score": pa.array(score)})

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def digest(documents: DataFrame) -> DataFrame:
    return identify(documents, fit(documents))

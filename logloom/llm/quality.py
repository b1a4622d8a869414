"""Quality classifier: a naive Bayes support vector machine.

Indicators of n-grams are scaled by the log-ratio of their frequencies in the two classes, counted over every
labelled training row; a linear hinge-loss model is then fitted to a bounded sample of these rows by dual
coordinate descent, and its margins are turned into probabilities on rows of the sample that were held back,
each class weighted by its share of all labelled rows.

N-grams, hashed into 2**BITS places: words, pairs of words, the last three letters of words, the marks that
words carry (what is neither letter nor digit), pairs of marks, and the first letters of lines' words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialise, per_worker, slices

BITS, BLOCKS = 18, 128
_MARKS, _LETTERS = re.compile(r"[\W_]+"), re.compile(r"[^\W_]+")
_MASK = np.uint64((1 << BITS) - 1)


class Features:
    """Distinct hashed n-grams of a text, sorted."""

    def __init__(self):
        self.memo = Memo(self.of_word)

    @staticmethod
    def of_word(word: str) -> bytes:
        low = word.lower()
        core = low if low.isalnum() else _MARKS.sub("", low)
        marks = "" if core is low else _LETTERS.sub("", low)
        shape = f"{marks[:4]}|{len(marks) > 4}|{bool(core)}|{core.isdigit()}|{word[:1].isupper()}"
        return np.array([zlib.crc32(low.encode("utf-8", "surrogatepass")), zlib.crc32(f"t{core[-3:]}".encode("utf-8", "surrogatepass")), zlib.crc32(f"m{shape}".encode("utf-8", "surrogatepass"))], np.uint32).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32)
        ids = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.uint32).reshape(-1, 3).astype(np.uint64)
        pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        every = np.concatenate([ids.ravel(), pairs[:, 0] >> np.uint64(40), pairs[:, 2] >> np.uint64(40)]) & _MASK
        seen = np.zeros(1 << BITS, np.bool_) if len(every) > (1 << (BITS - 3)) else None
        if seen is not None:
            seen[every] = True
            return np.flatnonzero(seen).astype(np.int32)
        return np.unique(every).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = (weights of the text's n-grams) / sqrt(their number) + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum(dtype=np.float64) / np.sqrt(max(1, len(features)))) + self.bias

    def score(self, features: np.ndarray) -> float:
        z = self.slope * self.margin(features) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-regularised hinge loss sum(cost * max(0, 1 - y * margin)) over rows of scale[features] / sqrt(number)."""
    w, bias, alpha, rng = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * scale, bias


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Newton steps for (slope, shift) of a logistic curve over weighted rows, towards smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, b = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - t)))
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, smoothing: float = 1.0, cost: float = 1.0) -> Model:
    """Learns from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, quality 0 or 1); other labels, and null ids or labels, are left out.

    Ratios are counted over all labelled rows. The hinge loss is fitted to ``sample`` rows of each class at most, whose
    n-grams are what reaches the driver: the rows with the smallest hashes (of id and text) among the ids with the
    ``sample`` smallest hashes, so an id with very many rows sends no more. A fifth of them is held back for the
    probabilities; there each class weighs as much as it has labelled rows, so ``sample`` does not move the scores'
    level. Without rows of both classes every score is the smoothed share of label 1. An id with both labels counts
    for both, and so does each of several rows of an id.
    """
    there = docs.select(F.col("doc_id").cast("long").alias("_d")).where("_d is not null").distinct()
    told = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("_d"), F.col("quality").cast("int").alias("y")).distinct().join(there, "_d", "left_semi")
    told = materialise(told.withColumn("h", F.xxhash64("_d", F.lit(4))), "labelled")
    cuts = [told.where(F.col("y") == y).orderBy("h", "_d").limit(sample).agg(F.max("h").alias("h")).first().h for y in (0, 1)]
    drawn = F.lit(False)
    for y, h in enumerate(cuts):
        if h is not None:
            drawn = drawn | ((F.col("y") == y) & (F.col("h") <= h))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(told.hint("shuffle_hash"), F.col("doc_id") == F.col("_d")).select("y", F.when(drawn, F.xxhash64("_d", "text", F.lit(4))).alias("drawn"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of rows drawn (block -1), then counts of n-grams in BLOCKS blocks and of rows (block BLOCKS)."""
        features, total, n = per_worker(Features), np.zeros((2, 1 << BITS), np.int32), np.zeros((2, 1), np.int32)
        for batch in slices(batches):
            ys, xs, hs = [], [], []
            for y, chosen, text in zip(*(batch.column(c).to_pylist() for c in ("y", "drawn", "text")), strict=True):
                x = features(text)
                total[y, x] += 1
                n[y] += 1
                if chosen is not None:
                    ys.append(y)
                    hs.append(chosen)
                    xs.append(x.tobytes())
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xs), -1, np.int32)), pa.array(ys, pa.int32()), pa.array(hs, pa.int64()), pa.array(xs, pa.binary())], ["block", "y", "h", "x"])
        for y in np.flatnonzero(n).tolist():
            cut = [c.tobytes() for c in (*np.array_split(total[y], BLOCKS), n[y])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS + 1, dtype=np.int32)), pa.array(np.full(BLOCKS + 1, y, np.int32)), pa.nulls(BLOCKS + 1, pa.int64()), pa.array(cut, pa.binary())], ["block", "y", "h", "x"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, y, x in zip(*(batch.column(c).to_pylist() for c in ("block", "y", "x")), strict=True):
                sums[block, y] = sums.get((block, y), 0) + np.frombuffer(x, np.int32).astype(np.int64)
        for (block, y), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([y], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "y", "x"])

    seen = materialise(rows.mapInArrow(extract, "block int, y int, h long, x binary"), "features")
    counted = seen.where("block >= 0").repartition(BLOCKS, "block", "y").mapInArrow(summed, "block int, y int, x binary")
    total, n = np.zeros((2, BLOCKS, (1 << BITS) // BLOCKS)), [0, 0]
    for r in counted.collect():  # 2 * (BLOCKS + 1) rows, whatever the input
        x = np.frombuffer(r.x, np.int64)
        if r.block == BLOCKS:
            n[r.y] = int(x[0])
        else:
            total[r.y, r.block] = x
    (zero, one), (n0, n1) = total.reshape(2, -1), n
    prior = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    p, q = one + smoothing, zero + smoothing
    scale = np.log((p / (n1 + 2 * smoothing)) / (q / (n0 + 2 * smoothing)))
    scale[(p == smoothing) & (q == smoothing)] = 0

    chosen = [r for y in (0, 1) for r in seen.where((F.col("block") < 0) & (F.col("y") == y)).orderBy("h", "x").limit(sample).select("y", "x").collect()]
    drawn_ = sorted(((r.y, np.frombuffer(r.x, np.int32)) for r in chosen), key=lambda r: (r[0], r[1].tobytes()))
    order = np.random.default_rng(4).permutation(len(drawn_))
    y = np.array([2 * drawn_[i][0] - 1 for i in order])
    xs = [drawn_[i][1] for i in order]
    held = np.arange(len(xs)) % 5 == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    fitted = np.flatnonzero(~held)
    share = {s: (y[fitted] == s).mean() for s in (-1, 1)}
    w, bias = dual_descent([xs[i] for i in fitted], scale, y[fitted], np.array([cost * 0.5 / share[s] for s in y[fitted]]))
    model = Model(w.astype(np.float32), bias, 1.0, 0.0)
    judged = np.flatnonzero(held) if held.any() else fitted
    margins = np.array([model.margin(xs[i]) for i in judged])
    weight = np.where(y[judged] > 0, n1 / max(1, (y[judged] > 0).sum()), n0 / max(1, (y[judged] <= 0).sum()))
    slope, shift = _platt(margins, y[judged], weight / weight.mean())
    return Model(model.weights, model.bias, slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: higher, nearer to 1, where label 1 is likelier.

    A null or empty text has no n-grams and gets the model's score of none; very long texts are scored whole;
    repeated rows get a score each; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = per_worker(Features), shared.value
        for batch in slices(batches):
            scores = [m.score(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mapped, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more.

    A null or empty text is judged by the model's score of no n-grams; repeated rows stay or go together; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = per_worker(Features), shared.value
        for batch in slices(batches):
            good = [m.score(features(t)) >= threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(mapped, docs.schema)

"""Operator 3: quality by naive Bayes support vectors.

Indicators of hashed n-grams (byte 2- to 4-grams inside words; 1- to 3-grams over the words' shapes, which also say if a word
repeats the one before) are scaled by their class log-count ratios and set to unit length; a linear hinge-loss model with
class-balanced costs is fitted by dual coordinate descent in numpy, on a bounded sample of labelled rows. A held-back part of
the sample sets the sigmoid that turns margins into scores.

Nulls and edge cases: a null or empty text has no n-grams and gets the score of the bias alone; labels other than 0 and 1 and null ids are not learned
from; with labels of one kind only, or none, every score is that kind's share (0.5 if none); a doc_id that repeats in the labels is
learned from once, with its least label; repeated documents each give a row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, one_each, runs, sample_ids, slices, table, text_bytes, word_grams

GRAM_BITS = 16
SHAPE_BITS = 14
LENGTHS = (2, 3, 4)
#: Labelled documents to learn from, half of each label.
SAMPLE = 3000
KEEP = 0.7
#: Letters and digits by kind; other bytes stand for themselves.
_KINDS = bytes(ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256))


def _shapes(piece: bytes) -> np.ndarray:
    """A hash of each word's whole shape: kinds of characters, runs of one kind as one."""
    kinds = np.frombuffer(piece.translate(_KINDS), np.uint8)
    if not len(kinds):
        return np.zeros(0, np.uint32)
    once = kinds[np.append(True, kinds[1:] != kinds[:-1])].tobytes().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, once), np.uint64, len(once)).astype(np.uint32)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted numbers of each text's n-grams."""
    out: list[np.ndarray] = []
    mark = np.zeros(1 << GRAM_BITS, bool)
    seen = np.zeros(1 << SHAPE_BITS, bool)
    shapes: list[np.ndarray] = []
    last: bytes | None = None
    at = -1

    def finish() -> None:
        nonlocal shapes, last
        shape = np.concatenate(shapes) if shapes else np.zeros(0, np.uint32)
        code = np.zeros(len(shape), np.uint32)
        for n in range(min(3, len(shape))):
            code = (code[: len(shape) - n] ^ shape[n:]) * np.uint32(0x9E3779B1) + np.uint32(n)
            seen[code >> np.uint32(32 - SHAPE_BITS)] = True
        out.append(np.concatenate([np.flatnonzero(mark), np.flatnonzero(seen) + (1 << GRAM_BITS)]).astype(np.int32))
        mark[:] = False
        seen[:] = False
        shapes, last = [], None

    for owners, pieces in runs(texts):
        grams = list(word_grams(pieces, LENGTHS, GRAM_BITS))
        for k, (owner, piece) in enumerate(zip(owners, pieces, strict=True)):
            if owner != at:
                if at >= 0:
                    finish()
                at = owner
            for buckets, cuts in grams:
                mark[buckets[cuts[k] : cuts[k + 1]]] = True
            words = piece.split()
            if words:
                same = np.fromiter(map(eq, words, [last, *words[:-1]]), bool, len(words))
                shapes.append(_shapes(piece) ^ same.astype(np.uint32) * np.uint32(0x5BD1E995))
                last = words[-1]
    if at >= 0:
        finish()
    return out


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray  # ratio times hinge-loss weight, for each n-gram
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def margin(self, at: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[at] ** 2).sum()))
        return (float(self.weights[at].sum()) / length if length else 0.0) + self.bias

    def score(self, at: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    size = (1 << GRAM_BITS) + (1 << SHAPE_BITS)
    counts = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == k] or [np.zeros(0, int)]), minlength=size) + smooth for k in (0, 1)]
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float64)


def dual_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 30, seed: int = 3,
    tolerance: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """The hinge-loss weights and the bias (a feature of value 1): one dual variable at a time, between 0 and its row's cost."""
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(size), 0.0
    share = np.bincount((y > 0).astype(int), minlength=2) / len(y)
    costs = np.where(y > 0, cost / (2 * share[1]), cost / (2 * share[0]))
    alpha = np.zeros(len(y))
    norms = np.asarray([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            slope = y[i] * (float(weight[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), costs[i])
            if (step := new - alpha[i]) != 0:
                weight[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < tolerance:
            break
    return weight, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the log loss with softened targets, both kinds weighing the same."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weigh = np.where(y == 1, len(y) / (2 * pos), len(y) / (2 * neg))
    x = np.stack([margins, np.ones(len(margins))], 1)
    at = np.asarray([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (weigh * (p - goal)) + 1e-3 * at
        hess = (x.T * (weigh * p * (1 - p))) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        at = at - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(at[0], 0.1)), float(at[1])


def train(rows: list[np.ndarray], y: np.ndarray, back: np.ndarray) -> Model:
    """Fit on rows with labels y; those marked in `back` set the sigmoid, and then also learn."""
    size = (1 << GRAM_BITS) + (1 << SHAPE_BITS)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0, float(y.mean()) if len(y) else 0.5)

    def fit(keep: np.ndarray) -> Model:
        own = [rows[i] for i in np.flatnonzero(keep)]
        ratios = log_count_ratios(own, y[keep])
        values = [ratios[r] / max(1e-9, float(np.sqrt((ratios[r] ** 2).sum()))) for r in own]
        weight, bias = dual_descent(own, values, 2.0 * y[keep] - 1, size)
        return Model(ratios, weight * ratios, bias, 4.0, 0.0)

    if all(len(set(y[m].tolist())) == 2 for m in (back, ~back)):
        first = fit(~back)
        slope, offset = sigmoid_fit(np.asarray([first.margin(rows[i]) for i in np.flatnonzero(back)]), y[back])
    else:
        slope, offset = 4.0, 0.0
    model = fit(np.ones(len(y), bool))
    model.slope, model.offset = slope, offset
    return model


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, rows=64):
        got = [at.astype("<i4").tobytes() for at in features(batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column(1), batch.column(2)], names=["at", "quality", "back"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from documents whose labels (doc_id, quality) are 0 or 1 and whose doc_id `usable` allows."""
    sure = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    sure = (sure.where(usable) if usable is not None else sure).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = sample_ids(sure, "quality", sample)  # few rows, by the sample's own bound
    back = (F.pmod(F.xxhash64(F.lit("back"), F.col("doc_id")), F.lit(4)) == 0).alias("back")
    chosen = one_each(docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(ids), "doc_id"))
    got = chosen.select("text", "quality", back).mapInArrow(_collect, "at binary, quality int, back boolean").collect()
    got = sorted(got, key=lambda r: (r.quality, r.back, r.at))
    return train([np.frombuffer(r.at, "<i4") for r in got], np.asarray([r.quality for r in got], int), np.asarray([r.back for r in got], bool))


def score_documents(docs: DataFrame, model: Model, fold: Column | None = None, keep: float = KEEP) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches):
            scores = [round(model.score(at), 6) for at in features(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= keep) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), (fold if fold is not None else F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def held_out() -> Column:
    return F.pmod(id_hash(), F.lit(4)) == 2


def op3_quality_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out()), held_out())

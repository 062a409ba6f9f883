"""Operator 7: language by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its words' byte n-grams (2 to 4 bytes between word marks, hashed to 2**15 rows).
Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled documents; another
part of the sample sets the temperature of the softmax and the confidence below which a document is rejected. Every language that
occurs is learned: the model has a column of DIMENSIONS weights for each.

Nulls and edge cases: a null text, or one without a letter, is `und` with score 0 and rejected; rows with a null lang are
predicted but never learned from; rows with a null doc_id are predicted, not learned from; rows that share a doc_id are learned from once; without labelled documents all are `und`; repeated rows
each give a row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, one_each, runs, sample_ids, slices, table, text_bytes, word_grams

BITS = 15
LENGTHS = (2, 3, 4)
DIMENSIONS = 16
#: Labelled documents to learn from, shared evenly among all the languages, each with at least one.
SAMPLE = 2400
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # (buckets, DIMENSIONS)
    soft: np.ndarray  # (DIMENSIONS, languages)
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        shares = bucket_shares([t.lower() for t in texts])
        hidden = np.asarray([share.astype(np.float32) @ self.embed[at] for at, share in shares], np.float32).reshape(-1, self.embed.shape[1])
        return hidden @ self.soft + self.bias


def bucket_shares(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their shares of the n-grams) of each text; at most 2**BITS of them."""
    out = []
    held: dict[int, np.ndarray] = {}
    at = -1

    def finish() -> None:
        total = held.pop(at)
        buckets = np.flatnonzero(total)
        out.append((buckets, total[buckets] / max(1, total.sum())))

    for owners, pieces in runs(texts):
        grams = [(b, c.tolist()) for b, c in word_grams(pieces, LENGTHS, BITS)]
        for k, owner in enumerate(owners):
            if owner != at:
                if at >= 0:
                    finish()
                at = owner
            own = np.bincount(np.concatenate([b[c[k] : c[k + 1]] for b, c in grams]), minlength=1 << BITS)
            held[at] = held[at] + own if at in held else own
    if at >= 0:
        finish()
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, rows=64):
        texts = [t.lower() for t in batch.column(0).to_pylist()]
        rows = [(lang, part, at.astype("<u4").tobytes(), share.astype("<f4").tobytes()) for lang, part, (at, share) in zip(*(batch.column(k).to_pylist() for k in (1, 2)), bucket_shares(texts), strict=True) if len(at)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
            names=["lang", "part", "at", "share"],
        )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 6, rate: float = 0.5, size: int = 16, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SGD over (class, buckets, shares): the embeddings, the softmax weights and the bias."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-0.5, 0.5, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    soft, bias = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    weight = np.bincount([c for c, _, _ in examples], minlength=classes).astype(np.float32)
    weight = len(examples) / (classes * np.maximum(weight, 1))  # every language counts alike
    steps = epochs * -(-len(examples) // size)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for k in range(0, len(order), size):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            rows = [examples[i] for i in order[k : k + size]]
            at = np.concatenate([r[1] for r in rows])
            share = np.concatenate([r[2] for r in rows])[:, None]
            starts = np.cumsum([0, *(len(r[1]) for r in rows[:-1])])
            of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            hidden = np.add.reduceat(embed[at] * share, starts, axis=0)
            gap = _softmax(hidden @ soft + bias)
            y = np.asarray([r[0] for r in rows])
            gap[np.arange(len(rows)), y] -= 1
            gap *= weight[y][:, None]
            back = gap @ soft.T
            soft -= lr * (hidden.T @ gap)
            bias -= lr * gap.sum(0) / len(rows)
            # The steps of rare buckets are small, as shares are: scaled up by the usual number of buckets of a text.
            np.add.at(embed, at, -lr * 50 * share * back[of])
    return embed, soft, bias


def calibrate(logits: np.ndarray, y: np.ndarray, lost: float = 0.001) -> tuple[float, float]:
    """The temperature with the least log loss on held-back rows, and the confidence that a share `lost` of the right ones is under (0.5 at most)."""
    if not len(y):
        return 1.0, 0.0
    best = min((0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-9).mean())
    p = _softmax(logits / best)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    return best, float(min(0.5, right[int(lost * len(right))] * 0.9)) if len(right) else 0.0


def fit(docs: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from rows of docs (doc_id, text, lang) that `usable` allows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    ids = sample_ids(rows, "lang", sample)
    # The ids are few by the sample's own bound; texts stay on the executors.
    chosen = one_each(rows.select("doc_id", "text", "lang").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi"))
    part = F.when(F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(5)) == 0, 1).otherwise(0).cast("int")
    got = chosen.select(text_bytes().alias("text"), "lang", part.alias("part")).mapInArrow(_features, "lang string, part int, at binary, share binary").collect()
    got = sorted(got, key=lambda r: (r.lang, r.part, r.at))
    languages = sorted({r.lang for r in got})
    if not languages:
        return Model([], np.zeros((1 << BITS, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    number = {x: k for k, x in enumerate(languages)}
    data = [(number[r.lang], np.frombuffer(r.at, "<u4"), np.frombuffer(r.share, "<f4")) for r in got]
    learned = {r.lang for r in got if not r.part}
    # A language that has rows to hold back only is learned from those.
    learn = [d for d, r in zip(data, got, strict=True) if not r.part or r.lang not in learned]
    embed, soft, bias = train(learn, len(languages))
    check = [d for d, r in zip(data, got, strict=True) if r.part and r.lang in learned]
    logits = np.asarray([share @ embed[at] for _, at, share in check], np.float32).reshape(-1, DIMENSIONS) @ soft + bias
    temperature, threshold = calibrate(logits, np.asarray([c for c, _, _ in check], int))
    return Model(languages, embed, soft, bias, temperature, threshold)


def predict(docs: DataFrame, model: Model, fold: Column | None = None) -> DataFrame:
    """Per document: doc_id, held_out (as `fold` says), lang_pred, score (calibrated probability) and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of DIMENSIONS numbers, and as many for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches):
            rows = []
            letters = batch.column(2).to_pylist()
            known = [bool(x) and bool(model.languages) for x in letters]
            each = iter(_softmax(model.logits([t for t, x in zip(batch.column(1).to_pylist(), known, strict=True) if x]) / model.temperature)) if any(known) else iter(())
            for x in known:
                if not x:
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                p = next(each)
                best = int(p.argmax())
                rows.append((model.languages[best], round(float(p[best]), 6), bool(p[best] < model.threshold)))
            langs, scores, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), (fold if fold is not None else F.lit(False)).alias("held_out"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns. A model without languages has nothing to go by: it
    rejects only texts without a letter."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches):
            keep = np.zeros(batch.num_rows, bool)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            tried = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))]
            if tried and not model.languages:
                keep[tried] = True
            elif tried:
                p = _softmax(model.logits([texts[k].encode() for k in tried]) / model.temperature)
                keep[tried] = p.max(axis=1) >= model.threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.pmod(id_hash(), F.lit(5)) == 0


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, ~held_out()), held_out())

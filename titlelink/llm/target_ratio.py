"""Operator 5: quality by a hashed n-gram log-likelihood ratio between trusted and raw text, beside fixed rules.

The n-grams are byte 2- to 4-grams of words between marks, hashed to 2**16 buckets. One multinomial is fitted to the
documents that labels trust (quality 1 in all of a document's labels), smoothed by the other, which is that of all documents. A document's score is the mean log
ratio over its n-grams; it is kept if no fixed rule fails and the score reaches the threshold, the same for every document.

Nulls and edge cases: a null text has no words; without n-grams, or without trusted documents, the score is 0; a null doc_id is
never trusted; repeated rows each count and give a row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs, slices, sums, table, text_bytes, with_labels, word_grams

BITS = 16
LENGTHS = (2, 3, 4)
#: Documents whose mean log ratio is below this are dropped: their n-grams are a fifth less likely in trusted text. Languages
#: that are labelled more or less often than others move by up to 0.15 either way.
THRESHOLD = -0.25
#: How many n-grams of the raw text the trusted text is taken to have besides its own.
PRIOR = 1000.0
SPACE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = tuple(bytes([b]) for b in b"#*$%&|<>")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trusted, bucket, n): what each task counts, at most 2 * 2**BITS rows."""
    totals = [np.zeros(1 << BITS, np.int64) for _ in range(2)]
    for batch in slices(batches):
        trusted = np.asarray(batch.column(1).to_pylist(), int)
        for owners, pieces in runs(batch.column(0).to_pylist()):
            sure = trusted[owners]
            for kind in np.unique(sure).tolist():
                for buckets, _ in word_grams([p for p, t in zip(pieces, sure, strict=True) if t == kind], LENGTHS, BITS):
                    totals[kind] += np.bincount(buckets, minlength=1 << BITS)
    for k in range(2):
        at = np.flatnonzero(totals[k])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(totals[k][at])], names=["trusted", "bucket", "n"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | all), from counts over every document."""
    sure = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id", F.lit(1).alias("trusted"))
    rows = with_labels(docs.select("doc_id", text_bytes().alias("text")), sure)
    counts = rows.select("text", F.coalesce("trusted", F.lit(0)).alias("trusted")).mapInArrow(_counter, "trusted int, bucket long, n long")
    got = counts.groupBy("trusted", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * 2**BITS rows
    table_ = np.zeros((2, 1 << BITS))
    table_[got["trusted"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    if not table_[1].sum():
        return np.zeros(1 << BITS)
    raw = table_.sum(0)
    share = raw / raw.sum()
    target = (table_[1] + PRIOR * share) / (table_[1].sum() + PRIOR)
    return np.where(raw > 0, np.log(np.where(raw > 0, target, 1)) - np.log(np.where(raw > 0, share, 1)), 0.0)


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    points = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    chars = points - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        v = len(numbers)
        if v < 2_000_000:
            windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].reshape(-1)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words), bool)
        for k in range(3):
            cover[k : k + len(windows)] |= twice
        repeated = int(cover.sum())
    return chars, symbols, repeats, repeated


def mean_ratios(ratios: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Each text's mean log ratio over its n-grams, 0 without any."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, pieces in runs(texts):
        for buckets, cuts in word_grams(pieces, LENGTHS, BITS):
            np.add.at(total, owners, sums(ratios[buckets], cuts))
            np.add.at(count, owners, np.diff(cuts))
    return total / np.maximum(count, 1)


def score_documents(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(ratios)  # 2**BITS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, texts = [], batch.column(1).to_pylist()
            scores = mean_ratios(held.value, texts).round(9).tolist()
            for doc, text, score in zip(batch.column(0).to_pylist(), texts, scores, strict=True):
                words = text.split()  # bytes split at just the six white-space bytes
                chars, symbols, lines, repeated = base_counts(text, words)
                n = len(words)
                failed = n < 50 or 100 * repeated > 50 * n
                rows.append((doc, n, chars, symbols, lines, repeated, failed, not failed and score >= threshold, score))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double",
    )


def op5_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))

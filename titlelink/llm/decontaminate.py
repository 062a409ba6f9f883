"""Operator 9: benchmark passages in documents, by q-gram lemma filtering over diagonal bands and banded alignment.

Texts are compared in lower-case ASCII letters with white space as single spaces, as UTF-8 bytes. An item of m bytes may be found with up to
k edits (a share of m). An alignment with k edits keeps at least m - q + 1 - k * q of the item's q-grams, on at most k + 1 neighbouring
diagonals; bands of twice that width, overlapping by half, each hold every such group whole. So per text: (1) positions whose 8 bytes
occur in any item, by a bitmap; (2) windows with enough of them for the items of some length; (3) there, the distinct q-grams
of each item in each band, counted against its bound; (4) a banded alignment of the item with what is left. Steps 1 to 3 lose nothing.

Items under LEAST bytes leave the bound too little to go by: they are found where they stand without an edit between words' ends, all at once
by an automaton. Items are made distinct before they are collected, and broadcast in parts of about 8 MB of text; a larger
benchmark takes more passes over the documents.

Nulls and edge cases: null or empty texts and items match nothing; a null id stays null; repeated documents each give their rows and
repeated items count under the least id; empty tables give an empty result; other columns are ignored by `leaks` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

Q = 8
RATE = 0.08
LEAST = 32
PART_BYTES = 8 << 20
MAP_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
HITS = "doc_id long, item_id long, edits int, start int, end int"


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def budget(m: int, rate: float = RATE) -> int:
    """The edits allowed in m bytes: a share of them, but no more than leave 8 q-grams to be found."""
    return max(0, min(int(rate * m), (m - Q + 1 - 8) // Q))


def codes(data: bytes) -> np.ndarray:
    """The 8 bytes at each place as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def align(item: bytes, text: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of item that begins at `low` to `high` in text, or None above k edits.

    Cell d of row i is the text position low - k + i + d, so a row holds the band's diagonals only.
    """
    exact = text.find(item, max(0, low), max(0, high) + len(item))
    if exact >= 0:
        return 0, exact, exact + len(item)
    width = high - low + 2 * k + 1
    pattern, base = np.frombuffer(item, np.uint8), low - k
    padded = np.zeros(len(item) + width + 1, np.int16) - 1
    a, b = max(0, base), min(len(text), base + len(padded))
    if b > a:
        padded[a - base : b - base] = np.frombuffer(text[a:b], np.uint8)
    step = np.arange(width, dtype=np.int32)
    row = np.where((step + base >= 0) & (step + base <= len(text)), 0, k + 1).astype(np.int32)
    origin = step + base
    for i, c in enumerate(pattern):
        swap = row + (padded[i : i + width] != c)
        drop = np.append(row[1:], k + 1) + 1
        best = np.minimum(swap, drop)
        source = np.where(swap <= drop, origin, np.append(origin[1:], 0))
        lead = np.minimum.accumulate(best - step)
        at = np.maximum.accumulate(np.where(best - step == lead, step, 0))
        row, origin = lead + step, source[at]
        if row.min() > k:
            return None
    d = int(row.argmin())
    start, end = int(origin[d]), base + len(item) + d
    return (int(row[d]), max(0, start), min(len(text), end)) if row[d] <= k else None


@dataclass
class Index:
    ids: list
    items: list[bytes]
    grams: np.ndarray  # the distinct codes, ascending
    first: np.ndarray  # where the places of each code begin in `item` and `place`
    item: np.ndarray
    place: np.ndarray
    bound: np.ndarray  # of distinct q-grams, for each item
    edits: np.ndarray
    short: list[bytes]  # the items under LEAST bytes; they count on from the others


def build(rows: list[tuple[int | None, bytes]], rate: float = RATE) -> Index | None:
    texts: dict[bytes, int | None] = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=True):
        if clean_ := normal(text or b""):
            texts[clean_] = i
    if not texts:
        return None
    items, short = (sorted(t for t in texts if (len(t) < LEAST) == small) for small in (False, True))
    ids = [texts[t] for t in items + short]
    if not items:
        return Index(ids, items, *[np.zeros(0, np.int64)] * 6, short)
    found = [codes(t) for t in items]
    code = np.concatenate(found)
    item = np.repeat(np.arange(len(items)), [len(c) for c in found])
    place = np.concatenate([np.arange(len(c)) for c in found])
    order = np.lexsort((place, item, code))
    grams, first = np.unique(code[order], return_index=True)
    edits = np.asarray([budget(len(t), rate) for t in items])
    # Q-grams that repeat inside an item are counted by place; an alignment keeps places, so the bound holds for places.
    bound = np.asarray([len(t) - Q + 1 - k * Q for t, k in zip(items, edits, strict=True)])
    return Index(ids, items, grams, np.append(first, len(code)), item[order], place[order], bound, edits, short)


class Finder:
    def __init__(self, index: Index):
        self.index = index
        self.automaton = None
        if index.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, item in enumerate(index.short, len(index.items)):
                self.automaton.add_word(item.decode("latin-1"), (k, len(item)))
            self.automaton.make_automaton()
        if not index.items:
            return
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[(index.grams * _MIX) >> np.uint64(64 - MAP_BITS)] = True
        sizes = np.asarray([len(t) for t in index.items])
        self.longest = int(sizes.max())
        self.half = int(index.edits.max()) + 1
        # Items of about one length share a window that holds any match of theirs whole, and the least of their bounds.
        spans = sizes + 2 * index.edits
        self.windows: list[tuple[int, int]] = []
        order = np.argsort(spans, kind="stable")
        at = 0
        while at < len(order):
            to = int(np.searchsorted(spans[order], spans[order[at]] * 1.15, "right"))
            own = order[at:to]
            self.windows.append((int(spans[own].max()), max(1, int(index.bound[own].min()))))
            at = to

    def find(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each item in the normalised text, at its best place."""
        return (self._long(data) if self.index.items else []) + (self._short(data) if self.automaton else [])

    def _short(self, data: bytes) -> list[tuple[int, int, int, int]]:
        found: dict[int, tuple[int, int, int]] = {}
        joins = lambda k: 0 <= k < len(data) and (data[k] >= 128 or chr(data[k]).isalnum())
        for last, (item, size) in self.automaton.iter(data.decode("latin-1")):
            start, end = last - size + 1, last + 1
            if item not in found and not (joins(start - 1) and joins(start)) and not (joins(end) and joins(last)):
                found[item] = (0, start, end)
        return [(k, *at) for k, at in sorted(found.items())]

    def _long(self, data: bytes) -> list[tuple[int, int, int, int]]:
        index = self.index
        code = codes(data)
        n = len(code)
        if not n:
            return []
        hit = self.map[(code * _MIX) >> np.uint64(64 - MAP_BITS)]
        total = np.zeros(n + 1, np.int32)
        np.cumsum(hit, out=total[1:])
        zone = np.zeros(n, bool)
        for window, dense in self.windows:
            if window >= n:
                if total[n] >= dense:
                    zone[:] = True
                    break
                continue
            full = np.zeros(n + 1, np.int32)
            np.cumsum(total[window:] - total[: n + 1 - window] >= dense, out=full[1 : n + 2 - window])
            full[n + 2 - window :] = full[n + 1 - window]
            if full[n]:
                # A place is in the zone if a dense window began at it or up to a window before.
                zone |= full[1:] > np.concatenate([np.zeros(window - 1, np.int32), full[: n - window + 1]])
        if not zone.any():
            return []
        at = np.flatnonzero(hit & zone)
        where = np.searchsorted(index.grams, code[at])
        where = np.minimum(where, len(index.grams) - 1)
        real = index.grams[where] == code[at]
        at, where = at[real], where[real]
        sizes = index.first[where + 1] - index.first[where]
        if not sizes.sum():
            return []
        flat = np.repeat(index.first[where], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        item, place = index.item[flat], index.place[flat]
        diagonal = np.repeat(at, sizes) - place
        found: dict[int, tuple[int, int, int]] = {}
        shift, span = self.longest + 4 * self.half, 2 * self.half
        for part in (0, self.half):
            band = (diagonal + shift + part) // span
            key = item.astype(np.int64) << 40 | band
            # Distinct places of the item in the band.
            pairs_ = np.unique(np.stack([key, place]), axis=1) if len(key) < 64 else self._distinct(key, place)
            keys, counts = np.unique(pairs_[0], return_counts=True)
            for each in keys[counts >= index.bound[keys >> 40]].tolist():
                k_item, k_band = each >> 40, each & ((1 << 40) - 1)
                low = k_band * span - shift - part
                got = align(index.items[k_item], data, low, low + span - 1, int(index.edits[k_item]))
                if got and (k_item not in found or got < found[k_item]):
                    found[k_item] = got
        return [(i, *got) for i, got in sorted(found.items())]

    @staticmethod
    def _distinct(key: np.ndarray, place: np.ndarray) -> np.ndarray:
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        return np.stack([key[new], place[new]])


def _part(docs: DataFrame, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)  # of at most PART_BYTES of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value)
        ids = held.value.ids
        for batch in slices(batches):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, ids[i], e, a, b) for i, e, a, b in finder.find(normal(raw))]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])],
                    names=["doc_id", "item_id", "edits", "start", "end"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, HITS)


def _indexes(benchmark: DataFrame, rate: float) -> Iterator[Index]:
    """The items in parts of about PART_BYTES of text, each text once under its least id, however often it stands there."""
    items = benchmark.where("text is not null").groupBy(text_bytes().alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()
        if index := build([(r.item_id, bytes(r.text)) for r in rows], rate):
            yield index


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the items found in each document, each at its best place in the normalised text."""
    found = [_part(docs, index) for index in _indexes(benchmark, rate)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    out, at = docs, docs.columns.index("text")
    for index in _indexes(benchmark, rate):
        held = docs.sparkSession.sparkContext.broadcast(index)  # about PART_BYTES of items

        def run(batches, held=held):
            finder = Finder(held.value)
            for batch in slices(batches):
                keep = [not finder.find(normal((t or "").encode())) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

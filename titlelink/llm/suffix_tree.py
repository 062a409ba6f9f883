"""Operator 4: language-model scores by a probabilistic suffix tree, beside a unigram base.

Symbols are bytes of the ASCII-lower-cased words joined by single spaces, ended by a newline (which no word holds); DEPTH newlines stand
before a text. Windows of a context of DEPTH symbols and the next one are counted over all training texts. Contexts of one to DEPTH
symbols that occur LEAST times, a fixed count, stay if their next symbols diverge from those of the context without its first symbol by
a test (count times Kullback-Leibler divergence, against a multiple of the log of all counts); their suffixes stay with them. So the
tree grows with the corpus. A context's distribution is smoothed with that of its suffix, the root's by adding one, and what was
never seen after a context has its suffix's probability times a factor. Texts are scored by the longest suffix kept.

The tree's probability of a word (its bytes and the separator behind) is mixed evenly with the base's: so a common word is never less
likely than half its share, and an unknown one has the tree's spelling. A text's score is the sum over its words of the log10 of
that mean; the base's factor for the end goes with the last word. Logs of single words are kept to 1/256.

Windows are counted in each task by sorting, dealt out as packed arrays by the three symbols before the next one, and merged there; a
context's suffixes of three symbols and more lie in its own bucket, so the levels from there on need no join. The tree is kept as a
table. Up to MOST_NODES rows of it are broadcast; a larger one is joined with the distinct windows of all texts, and each chunk of
texts gets back the log probabilities of its own windows only.

The base needs every word's count in the training texts, and words grow with the corpus: texts are taken in chunks, each with its
own vocabulary; vocabularies are summed by word hash (64 bits) and each chunk gets back the counts of its own words only.

Nulls and edge cases: a null or empty text, or one without words, is one end token; a null doc_id falls in the fold of the empty
text; repeated rows each count and give a row; with no training text the tree is its root and every count is 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, materialise, slices, table, text_bytes

#: A window (context and next symbol) is held in a long, so at most 6.
DEPTH = 6
#: The context symbols next to the next one by which windows are dealt out.
NEAR = 3
BUCKETS = 1024
#: The least count of a context.
LEAST = 2
#: A context stays if count * divergence (nats) is at least this many times log(all symbols).
TEST = 2.0
#: Weight of the suffix's distribution, in symbols.
SMOOTH = 8.0
#: The tree's share in a word's probability.
SHARE = 0.5
#: Rows of the tree that are broadcast, at 12 bytes each; windows whose scores a task keeps at hand.
MOST_NODES, MOST_KNOWN = 8_000_000, 1_500_000
END = 10
_PAD = bytes([END]) * DEPTH
CHUNK_TOKENS, CHUNK_WORDS = 4_000_000, 250_000
#: Symbols that are scored at a time.
RUN_SYMBOLS = 1 << 20
#: Where the rows of windows stand behind those of words in a chunk.
_BEHIND = 1 << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = 256
_ZSTD = pa.Codec("zstd", compression_level=3)


def stream(text: bytes) -> tuple[bytes, list[bytes]]:
    """The symbols of a text with what stands before it, and its words."""
    words = text.lower().split()
    return _PAD + b" ".join(words) + bytes([END]), words


def codes(data: bytes) -> np.ndarray:
    """The window at each place as one number: the next symbol first, then the context's from the nearest to the farthest.

    So a window's shorter ones are its leading digits, and the order of windows is that of all shorter ones.
    """
    n = max(0, len(data) - DEPTH)
    return np.ndarray((n,), "<u8", data + b"\0" * 8, strides=(1,)).astype(np.int64) & _low(DEPTH + 1)


def codes_in_runs(data: bytes) -> Iterator[np.ndarray]:
    """The windows in order, RUN_SYMBOLS at a time: a long text is never held as numbers whole."""
    for k in range(0, max(0, len(data) - DEPTH), RUN_SYMBOLS):
        yield codes(data[k : k + RUN_SYMBOLS + DEPTH])


def _low(symbols: int) -> int:
    return (1 << 8 * symbols) - 1


def pair_of(code, d: int):
    """The window with only d symbols of context."""
    return code >> 8 * (DEPTH - d)


def context_of(pair, d: int):
    """The d context symbols of a window that has d of them."""
    return pair & _low(d)


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


class _Counts:
    """Counted windows: sorted parts of like size are merged, so each window is handled a few times only."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, windows: np.ndarray) -> None:
        got = np.sort(windows)
        first = _starts(got)
        self.put(got[first], np.diff(np.append(first, len(got))))

    def put(self, found: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((found, counts))
        while len(self.parts) > 1 and len(self.parts[-2][0]) <= 2 * len(self.parts[-1][0]):
            self._merge(2)

    def _merge(self, n: int) -> None:
        every, counts = (np.concatenate([p[k] for p in self.parts[-n:]]) for k in range(2))
        order = np.argsort(every, kind="stable")  # of sorted runs: a merge
        every = every[order]
        first = _starts(every)
        self.parts[-n:] = [(every[first], np.add.reduceat(counts[order], first) if len(first) else counts)]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._merge(len(self.parts))
        return self.parts[0]


def _planes(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    wide = values.astype("<i8")
    return _ZSTD.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").reshape(-1)


def _bucket(windows: np.ndarray) -> np.ndarray:
    near = context_of(pair_of(windows, NEAR), NEAR).astype(np.uint64)
    return ((near * _MIX) >> np.uint64(64 - 32)).astype(np.int64) % BUCKETS


_PACKED = "bucket long, n long, windows binary, counts binary"


def _pack(bucket: int, found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    row = [[bucket], [len(found)], [_planes(np.diff(found, prepend=0))], [_planes(counts)]]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
        names=["bucket", "n", "windows", "counts"],
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of the task's texts with their counts, packed by bucket."""
    counts = _Counts()
    parts, size = [], 0
    for batch in slices(batches):
        for raw in batch.column(0).to_pylist():
            for windows in codes_in_runs(stream(raw)[0]):
                parts.append(windows)
                size += len(windows)
                if size > 2_000_000:
                    counts.add(np.concatenate(parts))
                    parts, size = [], 0
    if parts:
        counts.add(np.concatenate(parts))
    found, n = counts.all()
    bucket = _bucket(found)
    order = np.argsort(bucket.astype(np.int16), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[k] : cuts[k + 1]]
        yield _pack(k, found[at], n[at])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, windows, counts) of rows that come sorted by bucket."""
    bucket, counts = None, _Counts()
    for batch in batches:
        for k, n, windows, times in zip(*(batch.column(c) for c in range(4)), strict=True):
            if bucket is not None and k.as_py() != bucket:
                yield bucket, *counts.all()
                counts = _Counts()
            bucket = k.as_py()
            counts.put(np.cumsum(_numbers(windows.as_py(), n.as_py())), _numbers(times.as_py(), n.as_py()))
    if bucket is not None:
        yield bucket, *counts.all()


_NEAREST = "pair long, n long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, found, counts in _merged(batches):
        yield _pack(bucket, found, counts)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): the task's windows with one symbol of context fewer than the buckets are dealt by."""
    total = _Counts()
    for _, found, counts in _merged(batches):
        pair = pair_of(found, NEAR - 1)
        first = _starts(pair)
        total.put(pair[first], np.add.reduceat(counts, first))
    pair, n = total.all()
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def level(pair: np.ndarray, n: np.ndarray, d: int, above: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows with d symbols of context, in order, and above, the probability of each with d - 1: the smoothed probabilities; the
    contexts, in order; their counts; and their gain in nats (0 for those under the least count)."""
    context = context_of(pair, d)
    contexts, of = np.unique(context, return_inverse=True)
    m = np.bincount(of, n, len(contexts))
    gain = np.bincount(of, n * np.log(n / m[of] / above), len(contexts)) * (m >= least)
    return (n + SMOOTH * above) / (m[of] + SMOOTH), contexts, m, gain


def _nodes_of(d: int, pair: np.ndarray, p: np.ndarray, contexts: np.ndarray, m: np.ndarray, keep: np.ndarray) -> list[np.ndarray]:
    """Columns d, back, code, log of a level's kept contexts: their factors for what was never seen, and the windows seen."""
    held = keep[np.searchsorted(contexts, context_of(pair, d))]
    code = np.concatenate([contexts[keep], pair[held]])
    log = np.concatenate([np.log10(SMOOTH / (m[keep] + SMOOTH)), np.log10(p[held])])
    back = np.arange(len(code)) < int(keep.sum())
    return [np.full(len(code), d, np.int32), back, code, log]


_NODES = "d int, back boolean, code long, log double"


def _levels(total: int, near: np.ndarray, p_near: np.ndarray, least: int) -> object:
    """The rows of the tree from NEAR symbols of context on, from the buckets' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = TEST * math.log(max(2, total))
        for _, found, counts in _merged(batches):
            shorter, p = near, p_near
            made = []
            for d in range(NEAR, DEPTH + 1):
                every = pair_of(found, d)
                first = _starts(every)
                pair, n = every[first], np.add.reduceat(counts, first)
                above = p[np.searchsorted(shorter, pair >> 8)]
                p, contexts, m, gain = level(pair, n, d, above, least)
                made.append((d, pair, p, contexts, m, gain >= bar))
                shorter = pair
            needed = None
            out = []
            for d, pair, p, contexts, m, keep in reversed(made):
                if needed is not None:
                    keep |= np.isin(contexts, needed)
                needed = np.unique(contexts[keep] >> 8)
                out.append(_nodes_of(d, pair, p, contexts, m, keep))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "back", "code", "log"])

    return run


@dataclass
class Tree:
    column: np.ndarray  # of each byte; the last column is of bytes never seen in training
    root: np.ndarray  # log10 probability of each byte without a context
    nodes: DataFrame  # (d, back, code, log): of kept contexts of d symbols, the windows seen; with `back`, the contexts and their factors

    @cached_property
    def contexts(self) -> dict[bytes, np.ndarray]:
        """The kept contexts' distributions by column, collected: for small trees."""
        out = {b"": np.zeros(int(self.column.max()) + 1)}
        out[b""][self.column] = 10**self.root
        of = lambda code, d: code.to_bytes(d, "big")[::-1]
        for r in self.nodes.orderBy("d", F.col("back").desc()).collect():
            if r.back:
                context = of(r.code, r.d)
                out[context] = out[context[1:]] * 10**r.log
            else:
                out[of(context_of(r.code, r.d), r.d)][self.column[r.code >> 8 * r.d]] = 10**r.log
        return out


class Model:
    """The tree's rows as sorted arrays."""

    def __init__(self, root: np.ndarray, nodes: pa.Table):
        d, back, code, log = (nodes.column(k).to_numpy() for k in range(4))
        self.root, self.levels = root, []
        for k in range(1, DEPTH + 1):
            own = []
            for kind in (True, False):
                at = np.flatnonzero((d == k) & (back == kind))
                at = at[np.argsort(code[at])]
                own.append((code[at], log[at].astype(np.float32)))
            self.levels.append(own)

    def logs(self, windows: np.ndarray) -> np.ndarray:
        out = self.root[windows >> 8 * DEPTH].astype(np.float32)
        live = np.arange(len(windows))  # those with a longer context kept
        for d, (contexts, pairs) in enumerate(self.levels, 1):
            pair = pair_of(windows[live], d)
            at, has = _find(contexts[0], context_of(pair, d))
            live, pair = live[has], pair[has]
            if not len(live):
                break
            out[live] += contexts[1][at[has]]
            at, has = _find(pairs[0], pair)
            out[live[has]] = pairs[1][at[has]]
        return out


def _find(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values in a sorted array, and which of them are there."""
    if not len(of):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return at, of[at] == values


class _Known:
    """Log probabilities of windows, those met before kept at hand in the order of their mixed codes."""

    def __init__(self, logs):
        self.of, self.mixed, self.logs = logs, np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        """Of RUN_SYMBOLS windows at most."""
        mixed = windows.astype(np.uint64) * _MIX
        low = np.uint64(RUN_SYMBOLS - 1)
        # Sorting numbers is much faster than finding an order: the place stands in the low digits.
        order = (np.sort((mixed & ~low) | np.arange(len(windows), dtype=np.uint64)) & low).astype(np.int64)
        got = mixed[order]
        first = _starts(got)
        got = got[first]
        at, has = _find(self.mixed, got)
        if not has.all():
            if len(self.mixed) > MOST_KNOWN:
                self.mixed, self.logs, has = self.mixed[:0], self.logs[:0], np.zeros(len(has), bool)
            new = np.sort(windows[order[first[~has]]])  # ascending windows are looked up much faster
            logs, keys = self.of(new), new.astype(np.uint64) * _MIX
            by = np.argsort(keys, kind="stable")
            keys, logs = keys[by], logs[by]
            place = np.searchsorted(self.mixed, keys)
            value = self.logs[at] if len(self.mixed) else np.empty(len(got), np.float32)
            self.mixed, self.logs = np.insert(self.mixed, place, keys), np.insert(self.logs, place, logs)
            if np.array_equal(keys, got[~has]):
                value[~has] = logs
            else:  # keys that differ in their low digits only
                value = self.logs[np.searchsorted(self.mixed, got)]
        else:
            value = self.logs[at]
        out = np.empty(len(windows), np.float32)
        out[order] = np.repeat(value, np.diff(np.append(first, len(windows))))
        return out


def word_logs(known, streams: list[bytes]) -> np.ndarray:
    """The tree's log10 probability of each word with the separator behind it, of all texts in order; an empty text counts as one word."""
    data = b"".join(streams)
    byte = np.frombuffer(data, np.uint8)
    inside = np.ones(len(data), bool)
    ends = np.cumsum([len(x) for x in streams])
    for k in range(DEPTH):  # what stands before a text is no part of it
        inside[ends - [len(x) for x in streams] + k] = False
    flat = np.concatenate([np.zeros(DEPTH, np.float32), *(known(w) for w in codes_in_runs(data))])[inside].astype(np.float64)
    byte = byte[inside]
    stops = np.flatnonzero((byte == 32) | (byte == END))
    return np.add.reduceat(flat, np.append(0, stops[:-1] + 1)) if len(stops) else np.zeros(0)


def fit(docs: DataFrame, usable: Column | None = None, least: int = LEAST) -> Tree:
    rows = (docs.where(usable) if usable is not None else docs).select(text_bytes().alias("text"))
    spark = docs.sparkSession
    packed = rows.mapInArrow(_windows, _PACKED)
    counted = materialise(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge, _PACKED), "windows")
    # At most 2**(8 * NEAR) rows, of those that occur.
    got = counted.mapInArrow(_nearest, _NEAREST).groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    pair, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    single = np.bincount(pair >> 8 * (NEAR - 1), n, 256)
    total = int(n.sum())
    column = np.full(256, np.count_nonzero(single), np.int16)
    column[single > 0] = np.arange(np.count_nonzero(single))
    root = (single + 1.0) / (total + 256)
    bar = TEST * math.log(max(2, total))
    shorter, p, made = np.arange(256), root, []
    for d in range(1, NEAR):
        every = pair >> 8 * (NEAR - 1 - d)
        first = _starts(every)
        own, times = every[first], np.add.reduceat(n, first) if len(first) else n
        p, contexts, m, gain = level(own, times, d, p[np.searchsorted(shorter, own >> 8)] if len(own) else np.zeros(0), least)
        made.append((d, own, p, contexts, m, gain >= bar))
        shorter = own
    deep = materialise(counted.mapInArrow(_levels(total, shorter, p, least), _NODES), "nodes")
    # At most 2**(8 * (NEAR - 1)) contexts.
    needed = np.asarray([r[0] for r in deep.where((F.col("d") == NEAR) & F.col("back")).select(F.shiftright("code", 8)).distinct().collect()], np.int64)
    rows_: list[list] = []
    for d, own, p, contexts, m, keep in reversed(made):
        keep |= np.isin(contexts, needed)
        needed = np.unique(contexts[keep] >> 8)
        rows_.append(_nodes_of(d, own, p, contexts, m, keep))
    columns = [np.concatenate(c) for c in zip(*rows_, strict=True)]
    low = spark.createDataFrame(pa.table({name: pa.array(c) for name, c in zip(("d", "back", "code", "log"), columns, strict=True)}))
    return Tree(column, np.log10(root), materialise(deep.unionByName(low.select(F.col("d").cast("int").alias("d"), "back", "code", "log")), "tree"))


def _joined(windows: DataFrame, tree: Tree) -> DataFrame:
    """(code, log) of distinct windows, by joins with the tree's rows."""
    root = windows.sparkSession.createDataFrame([(b, float(x)) for b, x in enumerate(tree.root)], "b long, log double")
    at = windows.join(F.broadcast(root), F.shiftright("code", 8 * DEPTH) == F.col("b")).select("code", "log")
    for d in range(1, DEPTH + 1):
        own = tree.nodes.where(F.col("d") == d)
        contexts = own.where("back").select(F.col("code").alias("context"), F.col("log").alias("factor"))
        pairs = own.where("not back").select(F.col("code").alias("pair"), F.col("log").alias("own"))
        at = at.withColumn("pair", F.shiftright("code", 8 * (DEPTH - d))).withColumn("context", F.col("pair").bitwiseAND(_low(d)))
        at = at.join(contexts, "context", "left").join(pairs, "pair", "left").select("code", F.coalesce("own", F.col("log") + F.coalesce("factor", F.lit(0.0))).alias("log"))
    return at


_CHUNK = "chunk long, texts binary, words array<bigint>, trained array<bigint>, windows array<bigint>"
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("texts", pa.binary()), ("words", pa.list_(pa.int64())), ("trained", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64()))])
#: What stands in `texts`, as one Arrow message: a plain binary column costs nothing in the many rows that have none. Of each text its words'
#: numbers in the chunk, the end first, and their logs; or, without a model at hand, its symbols.
_TEXTS = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("ids", pa.binary()),
    ("logs", pa.binary()), ("n_logs", pa.int64()), ("streams", pa.list_(pa.binary())),
])


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _chunks(model) -> object:
    """Texts as numbers of their words within a chunk, with the tree's logs; without a model, with the texts' symbols and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = _Known(model.value.logs) if model else None
        part, seq = TaskContext.get().partitionId(), 0

        def fresh():
            return {"numbers": _Numbered({b"\n": 0}), "doc_ids": [], "held": [], "sizes": [], "ids": [], "logs": [], "streams": [], "windows": [], "tokens": 0}

        def give(c) -> pa.RecordBatch:
            nonlocal seq
            ids = np.concatenate(c["ids"])
            trains = np.repeat(~np.asarray(c["held"]), c["sizes"])
            trained = np.bincount(ids[trains], minlength=len(c["numbers"])).astype(np.int64)
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, c["numbers"]), np.uint64, len(c["numbers"])).astype(np.int64)
            logs = np.concatenate(c["logs"]) if c["logs"] else np.zeros(0, np.int64)
            own = [[c["doc_ids"]], [c["held"]], [c["sizes"]], [len(ids)], [_planes(ids)], [_planes(logs)], [len(logs)], [c["streams"]]]
            windows = np.unique(np.concatenate(c["windows"])) if c["windows"] else np.zeros(0, np.int64)
            texts = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(own, _TEXTS.types, strict=True)], schema=_TEXTS).serialize().to_pybytes()
            row = [[part << 32 | seq], [texts], [words], [trained], [windows]]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _CHUNK_ARROW.types, strict=True)], schema=_CHUNK_ARROW)

        c = fresh()
        for batch in slices(batches):
            streams = []
            for doc, raw, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data, words = stream(raw)
                streams.append(data)
                c["doc_ids"].append(doc)
                c["held"].append(held)
                c["sizes"].append(len(words) + 1)
                c["ids"].append(np.fromiter(map(c["numbers"].__getitem__, (b"\n", *words)), np.int32, len(words) + 1))
                c["tokens"] += len(words) + 1
            if streams and known:
                c["logs"].append(np.rint(word_logs(known, streams) * _STEPS).astype(np.int64))
            elif streams:
                c["streams"] += streams
                c["windows"].append(np.unique(np.concatenate([np.unique(w) for x in streams for w in codes_in_runs(x)])))
            if c["tokens"] >= CHUNK_TOKENS or len(c["numbers"]) >= CHUNK_WORDS:
                yield give(c)
                c = fresh()
        if c["doc_ids"]:
            yield give(c)

    return run


def mixed(tree: np.ndarray, base: np.ndarray, share: float = SHARE) -> np.ndarray:
    """log10 of the mean of two probabilities given as logs."""
    return np.logaddexp(tree * math.log(10) + math.log(share), base * math.log(10) + math.log(1 - share)) / math.log(10)


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _assemble(total: int, distinct: int) -> object:
    """Per document, from rows sorted by chunk and place: first the chunk's texts, then its words' counts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts, scored = None, [], []

        def give() -> pa.RecordBatch:
            c = np.concatenate(counts)
            n = texts["n"]
            sizes = np.asarray(texts["sizes"], np.int64)
            if texts["streams"]:
                log = np.concatenate(scored)
                words = np.isnan(log)
                windows, log, c = c[~words], log[~words], c[words]
                order = np.argsort(windows)
                windows, log = windows[order], log[order]
                known = _Known(lambda w: log[np.minimum(np.searchsorted(windows, w), len(windows) - 1)])
                tree = np.concatenate([np.rint(word_logs(known, texts["streams"][k : k + 256]) * _STEPS) for k in range(0, len(texts["streams"]), 256)]) / _STEPS
            else:
                tree = _numbers(texts["logs"], texts["n_logs"]) / _STEPS
            ids = _numbers(texts["ids"], n)
            first = np.cumsum(sizes) - sizes
            base = (np.log10(c + 1.0) - math.log10(total + distinct + 1))[ids]
            # The tree has one value for each word, or one for a text without any; the base also has the end, that comes first in ids.
            end = base[first]
            own = base.copy()
            own[first] = 0.0
            mine = np.ones(n, bool)
            mine[first] = sizes == 1
            own[first + sizes - 1] += end
            other = math.log10(max(1e-12, 1 - 10 ** float(end[0])))  # that a text goes on: with its first word, and not its last
            more = sizes > 1
            own[first[more] + 1] += other
            own[(first + sizes - 1)[more]] -= other
            counted = np.maximum(sizes - 1, 1)
            score = np.add.reduceat(mixed(tree, own[mine]), np.cumsum(counted) - counted)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(texts["doc_ids"], pa.int64()), pa.array(texts["held"], pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat((c[ids] > 0).astype(np.int64), first)),
                    pa.array(np.full(len(sizes), total, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(score),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            place, c, log = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4))
            cuts = sorted({0, *np.flatnonzero(place < 0).tolist(), len(place)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if place[a] < 0:
                    if texts is not None:
                        yield give()
                    texts, counts = pa.ipc.read_record_batch(pa.py_buffer(batch.column(3)[a].as_py()), _TEXTS).to_pylist()[0], []
                    scored = []
                    a += 1
                counts.append(c[a:b].copy())
                scored.append(log[a:b].astype(np.float64))
        if texts is not None:
            yield give()

    return run


def score_documents(docs: DataFrame, tree: Tree, fold: Column | None = None, most: int = MOST_NODES) -> DataFrame:
    """Per document: fold, tokens, those known from training, the base's and the tree's log10 probability."""
    few = tree.nodes.limit(most + 1).count() <= most
    model = docs.sparkSession.sparkContext.broadcast(Model(tree.root, tree.nodes.toArrow())) if few else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), (fold if fold is not None else F.lit(False)).alias("held"))
    chunks = materialise(rows.mapInArrow(_chunks(model), _CHUNK), "chunks")
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "trained")).alias("place", "w")).select(
        "chunk", "place", F.col("w.words").alias("word"), F.col("w.trained").alias("n"),
    )
    counts = materialise(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    none, nan = F.lit(None).cast("binary").alias("texts"), F.lit(float("nan")).cast("double").alias("log")
    known = words.select("chunk", "place", "word").join(counts, "word", "left").select(
        "chunk", F.col("place").cast("long").alias("place"), F.coalesce("c", F.lit(0)).alias("c"), none, nan,
    )
    heads = chunks.select("chunk", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("c"), "texts", nan)
    both = known.unionByName(heads)
    if not few:
        windows = chunks.select("chunk", F.explode("windows").alias("code"))
        logs = materialise(_joined(windows.select("code").distinct(), tree), "logs")
        both = both.unionByName(windows.join(logs, "code").select("chunk", F.lit(_BEHIND).cast("long").alias("place"), F.col("code").alias("c"), none, "log"))
    # A chunk is a few MB: so many partitions that each task gets a few of them.
    both = both.repartition(max(1, chunks.select("chunk").count() // 2), "chunk").sortWithinPartitions("chunk", "place")
    return both.mapInArrow(_assemble(total or 0, distinct or 0), _OUT)


def held_out() -> Column:
    return F.pmod(id_hash(), F.lit(7)) == 2


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, ~held_out()), held_out())
